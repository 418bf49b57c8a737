"""Repeats where rows come again whole: texts are not dealt out a second time to drop them."""

import io
import random
from contextlib import redirect_stdout

from aerocal.llm import repeats
from aerocal.llm.repeats import drop_repeats


def test_repeated_rows_are_no_repeats_of_themselves(spark, monkeypatch):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    own = ["".join(rng.choice("ijklmnop ") for _ in range(300)) for _ in range(6)]
    rows = [(i, own[i] + passage + own[i][::-1]) for i in range(6)]
    df = spark.createDataFrame([*rows, rows[0], rows[0], rows[3]], "doc_id long, text string").repartition(3)
    plans, write = [], repeats.materialise

    def told(found, label):
        with redirect_stdout(io.StringIO()) as out:
            found.explain()
        plans.append((label, out.getvalue()))
        return write(found, label)

    monkeypatch.setattr(repeats, "materialise", told)
    for bucket in (2000, 1):  # in a group, and by windows
        got = {r.doc_id: (r.n_removed, r.n_spans) for r in drop_repeats(df, 100, with_kept=False, bucket=bucket).collect()}
        assert got[0] == (0, 0)
        assert all(got[i][0] >= 150 and got[i][1] == 1 for i in range(1, 6))
    covers = [p for label, p in plans if label == "covers"]
    assert covers
    assert not any("first(text" in p for p in covers)
