import random

from dossier.llm import line_dedup


def run(frame, **more):
    made = line_dedup.drop_lines(frame, **more)
    assert made.columns == [*frame.columns, "n_lines", "n_dropped"]
    return made.collect()


def test_recurring_lines_go_and_the_first_text_keeps_them(table, odd_rows):
    random.seed(2)
    pool = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    prose = lambda n: " ".join(random.choices(pool, k=n))
    passage, legal = prose(60), "All rights reserved."
    rows, kept = [], {}
    for i in range(20, 60):
        lines = [prose(random.randint(4, 14)) for _ in range(5)]
        clean = list(lines)
        if i % 2:
            lines.insert(2, passage)
        if i % 3 == 0:
            lines.insert(0, legal)
        lines.insert(1, f"Read {random.randint(1, 9999)} of {random.randint(1, 99)} times on day {i}x")
        rows.append((i, "\n".join(lines)))
        kept[i] = "\n".join(clean if i != 20 else [*clean[:1], lines[1], *clean[1:]] if "Read" in lines[1] else clean)
    first = {20: rows[0][1]}  # has the smallest id with the counted line
    rows += [(i, rows[0][1]) for i in (70, 71, 72)]  # exact copies of the text that keeps the line keep it too
    out = {(r.doc_id, r.text): r for r in run(table([*rows, *odd_rows]))}
    for (i, text), r in out.items():
        if i == 20 or i in (70, 71, 72):
            assert text == first[20] and r.n_dropped == 0
        elif i is not None and 22 <= i < 60:
            had_passage, had_legal = i % 2 == 1, i % 3 == 0
            assert (passage in text.split("\n")) == (i == 21) and "Read" not in text and (legal in text) == (had_legal and i == 21)
            assert r.n_dropped == 1 + (had_passage and i != 21) + (had_legal and i != 21)
            assert kept[i] == "\n".join(x for x in text.split("\n") if x not in (passage, legal))
    odd = [r for (i, _), r in out.items() if i is None or i < 20]
    assert all(r.n_dropped == 0 for r in odd) and {r.text for r in odd} == {t for _, t in odd_rows}
    assert all(r.n_lines == (0 if r.text is None else r.text.count("\n") + 1) for r in odd)


def test_few_texts_and_short_lines_stay(table):
    rows = [(i, f"the same line in five texts\nyes\n\nown {'abcdefghij'[i]}") for i in range(5)]
    assert all(r.n_dropped == 0 for r in run(table(rows)))
    assert sorted(r.n_dropped for r in run(table([*rows, (9, "the same line in five texts\nyes")]))) == [0, 1, 1, 1, 1, 1]
    assert run(table([])) == []


def test_prose_that_begins_alike_is_not_a_template(table):
    random.seed(4)
    rows = [(i, "We saw that " + " ".join(f"w{chr(97 + random.randrange(26))}{chr(97 + random.randrange(26))}" for _ in range(9))) for i in range(40)]
    assert all(r.n_dropped == 0 for r in run(table(rows)))


def test_long_lines_recur_from_fewer_texts_on(table):
    random.seed(5)
    prose = lambda n: " ".join("".join(random.choices("abcdefgh", k=5)) for _ in range(n))
    for n, texts, recurs in ((60, 2, True), (50, 2, True), (49, 2, False), (20, 3, True), (19, 5, False), (5, 5, False), (5, 6, True)):
        line = prose(n)
        rows = [(i, f"{prose(8)}\n{line}\n{prose(60)}") for i in range(texts)]
        out = sorted((r.doc_id, r.n_dropped, r.text) for r in run(table([*rows, (9, rows[0][1])])))
        assert [x[1] for x in out] == [0, *[int(recurs)] * (texts - 1), 0], (n, texts)
        assert all((line in x[2]) == (x[1] == 0) for x in out)


def test_rows_of_numbers_are_no_template(table):
    number = lambda: f"{random.randint(1000, 9999)}.{random.randint(10, 99)}"
    random.seed(7)
    rows = [(i, f"{number()} {number()} {number()}\nthe sum {number()} {number()} {number()}\nall of it {number()}\nTable 7 of 9\nread {number()} times on this very day") for i in range(20)]
    for r in run(table(rows)):
        kept = dict(rows)[r.doc_id].split("\n")
        # What repeats word for word goes, and so does a template of enough constant words.
        assert r.text.split("\n") == (kept if r.doc_id == 0 else kept[:3]) and r.n_dropped == (2 if r.doc_id else 0)


def test_a_leaf_with_many_templates(table):
    random.seed(8)
    name = lambda: "".join(random.choices("abcdefgh", k=9))
    shapes = [f"INFO %s {a} and {b} took %s of {c} in the end" for a, b, c in [(name(), name(), name()) for _ in range(9)]]
    shapes += [f"INFO %s {shapes[0].split()[2]} or {name()} gave %s to {name()} at the end"]
    other = [(100 + i, f"2024-05-01 10:11 INFO {' '.join(name() for _ in range(11))}") for i in range(30)]
    rows = []
    for i in range(60):
        line = shapes[i % len(shapes)] % (name(), name())
        rows.append((i, f"{name()} {name()} {name()}\n2024-05-{i % 28 + 1:02d} 10:{i % 60:02d} {line}"))
    out = {r.doc_id: r.n_dropped for r in run(table(rows + other))}
    assert all(out[i] == (i >= len(shapes)) for i in range(60)) and not any(out[i] for i, _ in other)


def test_lines_go_by_their_numbers(spark):
    random.seed(7)
    rows = [(None, None), ("", None), ("", [0]), ("\n", [0, 1]), ("a", [0]), ("a\nb\n", [1, 2])]
    for _ in range(300):
        text = "\n".join("é漢x"[: random.randint(0, 3)] for _ in range(random.randint(1, 7)))
        rows.append((text, sorted(random.sample(range(text.count("\n") + 1), random.randint(0, text.count("\n") + 1)))))
    rows.append(("\n".join(f"line {i}" for i in range(200_000)), list(range(0, 200_000, 2))))
    made = line_dedup.without_lines(spark.createDataFrame(rows, "text string, drops array<int>")).collect()
    for r in made:
        assert r.kept == (r.text if r.drops is None else "\n".join(x for x, gone in zip(r.text.split("\n"), marks(r)) if not gone))


def marks(row):
    gone = [False] * (row.text.count("\n") + 1)
    for i in row.drops:
        gone[i] = True
    return gone


def test_columns_of_the_caller_stay(spark):
    line = "this is one line that very many texts share"
    frame = spark.createDataFrame([(i, f"own words of text number {i}a\n{line}", 77, "d") for i in range(9)], "doc_id long, text string, n_lines int, n_dropped string")
    made = line_dedup.drop_lines(frame)
    assert made.columns == ["doc_id", "text", "n_lines", "n_dropped", "n_lines_", "n_dropped_"]
    rows = made.collect()
    assert {(r.n_lines, r.n_dropped, r.n_lines_) for r in rows} == {(77, "d", 2)} and sorted(r.n_dropped_ for r in rows)[-1] >= 1
