"""Corroboration equals a walk over the list."""

import random

from dossier.operators import matching


def test_first_name_in_list_order(spark):
    random.seed(3)
    word = lambda n: "".join(random.choices("aBc ", k=n))
    titles = [(i, word(random.randint(0, 12))) for i in range(120)] + [(500, None)]
    names = [word(random.randint(1, 4)) for _ in range(15)] + [""]
    expected = {}
    for i, title in titles:
        hit = next((n for n in names if n and n.lower() in (title or "").lower()), None)
        if title and hit is not None:
            expected[i] = hit.lower()
    posts = spark.createDataFrame(titles, "i int, post_title string")
    listed = spark.createDataFrame(list(enumerate(names)), "position int, name string")
    got = matching.corroborate(posts, listed)
    assert {r.i: r.matched_victim.lower() for r in got.collect()} == expected
