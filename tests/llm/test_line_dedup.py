import random

from pyspark.sql import functions as F

from edgeloom.llm.line_dedup import dedup_lines


def by_hand(docs):
    """docs: (id, text) in order of id, texts distinct."""
    seen, out = set(), {}
    for d, text in docs:
        lines = (text or "").split("\n")
        full = [(x.strip(" \t\r"), i) for i, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for a, b, c in zip(full, full[1:], full[2:]):
            window = (a[0], b[0], c[0])
            if window in seen:
                gone |= set(range(a[1], c[1] + 1))
            seen.add(window)
        out[d] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, "\n".join(rng.choice(["a", "b", " b", "", "c\t", "d d", "é"]) for _ in range(rng.randint(0, 25))) + f"\nend {i}") for i in range(150)]
    docs += [(200, None), (201, ""), (202, "one\ntwo"), (203, "x\ny\nz\nx\ny\nz\nx\ny\nz"), (204, "\n".join(f"l{i % 700}" for i in range(5000)))]
    df = spark.createDataFrame([(d, t, "n") for d, t in docs], "doc_id long, text string, covered string").withColumn("start", F.lit(1))
    got = dedup_lines(df)
    assert got.columns == [*df.columns, "__lines", "__removed"]
    want = by_hand(docs)
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.text == want[r.doc_id]
        text = dict(docs)[r.doc_id]
        assert r["__lines"] == (0 if text is None else len(text.split("\n")))


def test_repeated_rows_and_empty_table(spark):
    same = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (None, "a\nb\nc\nd")]
    df = spark.createDataFrame(same, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in dedup_lines(df).collect() if r.doc_id) == [(1, ""), (1, ""), (2, "")]
    assert [r.text for r in dedup_lines(df).collect() if r.doc_id is None] == ["a\nb\nc\nd"]
    assert dedup_lines(df.limit(0)).count() == 0
