import random
import re
from collections import Counter

from pyspark.sql import functions as F

from edgeloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] >= 2 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_base_rules(spark):
    rng = random.Random(2)
    texts = ["", None, "a", "a b c", "a b c a b c", "x x x x", "é# <b>|\n\n é#\x0b\x1cq \x85 u\xa0v", "日本 語\n" * 4]
    texts += ["".join(rng.choice(["a", "b", "ab", " ", "  ", "\n", "é", "#"]) for _ in range(rng.randint(1, 400))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, f"h{i % 3}", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    rows = quality.quality(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == base(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_lines_above_the_limit(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join("w%06d" % rng.randrange(10**6) for _ in range(n))
    menu = fresh(60)
    docs = []
    for i in range(90):
        host = "hot" if i < 60 else None if i < 75 else "other"
        mine = 30 if i % 2 else 80
        docs.append((i, f"{menu.upper() if i % 3 else menu}\n{fresh(mine)}", host))
    docs.append((0, docs[0][1], "hot"))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for min_docs in (20, 59, 60):
        rows = quality.quality(df, min_docs=min_docs).collect()
        assert len(rows) == len(docs)
        for r in rows:
            above = {"hot": 60, None: 15, "other": 15}[docs[r.doc_id][2]] > min_docs
            assert r.removed_words == (60 if above else 0)
            assert r.kept == (not above or r.doc_id % 2 == 0)
    assert quality.quality(df.limit(0)).count() == 0


def cleaned_by_hand(docs, min_docs, share):
    """docs: (id, text, host), ids once. Texts of the kept documents without lines above the limit."""
    norm = lambda x: " ".join(WORD.findall(x)).translate({c: c + 32 for c in range(65, 91)})
    held, hosts = Counter(), Counter(h for _, _, h in docs)
    for _, text, host in docs:
        held.update({(host, norm(x)) for x in (text or "").split("\n") if WORD.search(x)})
    out = {}
    for d, text, host in docs:
        above = lambda x: WORD.search(x) and held[host, norm(x)] > max(min_docs, share * hosts[host])  # noqa: E731, B023
        words, _, _, _, _, failed = base(text)
        gone = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if above(x))
        if not failed and gone <= 0.5 * words:
            out[d] = "\n".join(x for x in text.split("\n") if not above(x))
    return out


def test_texts_without_the_lines(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join("w%06d" % rng.randrange(10**6) for _ in range(n))
    menu, foot = fresh(12), fresh(5)
    docs = []
    for i in range(120):
        lines = [fresh(25), fresh(30), ""] + [menu.upper() if i % 2 else "  " + menu.replace(" ", "\t ")] * (i % 3) + [foot] * (i % 5 == 0)
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines), ["a", "b", None][i % 7 % 3]))
    docs += [(200, None, "a"), (201, "", "a"), (202, fresh(60) + "\r\n\x0b" + menu, "a")]
    df = spark.createDataFrame([(*d, k) for k, d in enumerate(docs)], "doc_id long, text string, source string, row int").selectExpr("*", "'x' AS doc", "'y' AS c0")
    for min_docs, share in ((8, 0.0), (3, 0.5), (1000, 0.0)):
        out = quality.cleaned(df, min_docs=min_docs, share=share)
        assert out.columns == df.columns and out.filter("doc <> 'x' OR c0 <> 'y'").count() == 0
        want = cleaned_by_hand(docs, min_docs, share)
        assert {r.doc_id: r.text for r in out.collect()} == want
        figures = {r.doc_id: r for r in quality.quality(df, min_docs=min_docs, share=share).collect()}
        assert {d for d, r in figures.items() if r.kept} == set(want)
        texts = {d: t for d, t, _ in docs}
        assert all(figures[d].removed_words == len(WORD.findall(texts[d])) - len(WORD.findall(t)) for d, t in want.items())
    none = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert quality.cleaned(none, min_docs=8, share=0.0).count() == len(cleaned_by_hand(docs, 8, 0.0))
    assert quality.cleaned(df.limit(0)).count() == 0
