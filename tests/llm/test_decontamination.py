import hashlib
import random
import re

from dossier.llm import decontamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    wanted = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            wanted.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in wanted}:
            for i in range(len(w) - n + 1):
                if (own := wanted.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(docs, items):
    made = decontamination.find_overlaps(docs, items)
    assert made.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in made.collect()), key=repr)


def test_agrees_with_brute_force(spark, table, odd_rows):
    random.seed(5)
    pool = [f"w{k}" for k in range(40)] + ["Über", "naïve", "漢字"]
    items = [(k, " ".join(random.choices(pool, k=random.choice([3, 8, 10, 14, 30])))) for k in range(30)] + [(3, "again with its id " * 4), (99, None), (98, " .,; "), (97, "")]
    docs = list(odd_rows)
    for k in range(60):
        parts = random.choices(pool, k=30)
        if k % 2:
            w = words(random.choice(items)[1])
            at = random.randint(0, max(0, len(w) - 10))
            parts += [x.upper() for x in w[at : at + random.randint(8, 20)]] + random.choices(pool, k=20)
        docs.append((100 + k, ", ".join(parts)))
    frame = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, hash string")
    assert run(table(docs), frame) == brute(docs, items)


def test_empty_tables(spark, table):
    none = spark.createDataFrame([], "item_id long, text string")
    assert run(table([(1, "some words here")]), none) == brute([(1, "some words here")], [])
    assert run(table([]), none) == []
