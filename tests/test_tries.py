"""Byte tries equal a search for every name in every text."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from dossier.operators import matching, tries


def brute(texts, names, alone):
    found = set()
    for t, text in enumerate(texts):
        raw = (text or "").encode()
        for n, name in enumerate(names):
            for match in re.finditer(b"(?=" + re.escape(name.encode()) + b")", raw):
                a, z = match.start(), match.start() + len(name.encode())
                if not alone or not (re.search(rb"[a-z0-9]$", raw[:a]) or re.match(rb"[a-z0-9]", raw[z:])):
                    found.add((t, a, n))
    return found


@pytest.mark.parametrize("alone", [False, True])
@pytest.mark.parametrize("stretch", [1 << 20, 7])
def test_every_place_of_every_name(alone, stretch, monkeypatch):
    monkeypatch.setattr(tries, "STRETCH", stretch)
    random.seed(8)
    for letters in ("ab", "ab .", "aé漢 1", "abcdefgh -"):
        word = lambda n: "".join(random.choices(letters, k=n))
        texts = [None, "", *(word(random.randint(0, 40)) for _ in range(60)), "", None]
        names = sorted({word(random.randint(1, 9)) for _ in range(50)} | {t[2:30] for t in texts if t and len(t) > 3}, key=lambda _: random.random())
        trie = tries.build(pa.array(names))
        column = pa.array(["skipped", *texts])[1:]  # an offset into its buffers
        data, offsets = tries.byte_buffer(column)
        got = [(int(t), int(a - offsets[t]), int(n)) for t, a, n in zip(*trie.places(data, offsets, alone))]
        assert len(got) == len(set(got)) and set(got) == brute(texts, names, alone)
        rows = pa.StructArray.from_arrays([pa.array(names)], names=["needle"])
        lists = [sorted(r["needle"] for r in x) for x in tries.named_in(trie, rows, column, alone).to_pylist()]
        assert lists == [sorted({names[n] for t, _, n in set(got) if t == k}) for k in range(len(texts))]


def test_no_names_and_no_texts():
    for names in ([], ["abc"]):
        trie = tries.build(pa.array(names, pa.string()))
        for texts in ([], [None, ""], ["xx"]):
            assert all(len(x) == 0 for x in trie.places(*tries.byte_buffer(pa.array(texts, pa.string()))))


def test_many_names_need_no_loop():
    rng = np.random.default_rng(3)
    names = pa.array([f"name {i:x} of {i * 7919 % 1000003}" for i in range(100_000)])
    trie = tries.build(names)
    texts = pa.array([f"here is name {i:x} of {i * 7919 % 1000003}, and more" for i in rng.integers(0, 100_000, 20_000).tolist()])
    text, _, name = trie.places(*tries.byte_buffer(texts))
    assert set(text.tolist()) == set(range(20_000)) and all(names[int(n)].as_py() in texts[int(t)].as_py() for t, n in zip(text[:500], name[:500]))


def test_several_tries(spark, monkeypatch):
    monkeypatch.setattr(matching, "SHARD_BYTES", 20)
    texts = spark.createDataFrame([(i, f"x{i} y{i}, z{i}") for i in range(40)], "i int, t string")
    names = spark.createDataFrame([(f"Y{i}", i) for i in range(40)] + [("z1", -1)], "name string, position int")
    got = {(r.i, r.needle) for r in matching.contained_names(texts, ["i"], "t", names).collect()}
    assert got == {(i, f"y{j}") for i in range(40) for j in range(40) if f"y{j}" in f"x{i} y{i}, z{i}"} | {(i, "z1") for i in range(40) if "z1" in f"z{i}"}
    told = {r.i: r.matched_victim for r in matching.corroborate(texts, names, title="t").collect()}
    assert told[5] == "Y5" and told[1] == "z1" and told[13] == "z1" and told[23] == "Y2"


def test_no_row_is_shuffled_for_the_texts(spark):
    texts = spark.range(100).selectExpr("id", "'a b' AS question")
    names = spark.createDataFrame([("a",), ("bb",)], "name string")
    plan = matching.longest_name(texts, "question", names, "found", alone=True)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan and "Join" not in plan
