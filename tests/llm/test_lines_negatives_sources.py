"""Line dedup, hard negatives and the audit of sources: against plain loops, and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, lines, negatives
from tidemark.llm.divergence import audit_sources, probabilities, terms_of
from tidemark.llm.lines import LineRuns, dedup_lines, drop_common_lines, index_lines, keys_of
from tidemark.llm.negatives import Block, limits, mine_negatives
from tidemark.llm.store import written

# --- lines ------------------------------------------------------------------------


def deduped(texts: list, least: int, min_chars: int = 1) -> list:
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    split = [(t or "").split("\n") for t in texts]
    seen = Counter(k for s in split for k in {key(x) for x in s})
    gone = {k for k, n in seen.items() if n >= least and len(k) >= min_chars}
    out = []
    for t, s in zip(texts, split, strict=True):
        kept = [x for x in s if key(x) not in gone]
        out.append((t if t is None else "\n".join(kept), len(s), len(s) - len(kept)))
    return out


def line_texts(n: int, seed: int) -> list:
    rng = random.Random(seed)
    words = ["Menu", " menu ", "MENU\t", "é", "É", "", "  ", "a b", "A  b", "\x1f", "\x85", "x" * 5000, "one", "two", "tail\r"]
    texts = ["\n".join(rng.choice(words) if rng.random() < 0.5 else f"line {rng.randrange(60)}" for _ in range(rng.randrange(12))) for _ in range(n)]
    return [*texts, None, "", "\n\n", "Menu", "Menu", "y\n" * 3000]


@pytest.mark.parametrize(("seed", "least", "frequent"), [(1, 10, 1 << 17), (2, 3, 2)])
def test_lines_against_a_loop(spark, monkeypatch, seed, least, frequent):
    monkeypatch.setattr(lines, "FREQUENT_KEYS", frequent)  # most common keys are dealt out then
    texts = line_texts(150, seed)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(11)
    rows = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(frame, least).collect()}
    assert [rows[k] for k in range(len(texts))] == deduped(texts, least)
    rows = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(frame, least, min_chars=2, batches=3).collect()}
    assert [rows[k] for k in range(len(texts))] == deduped(texts, least, 2)


def test_runs_are_few_and_hold_totals(spark, monkeypatch):
    texts = line_texts(200, 4)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    keys = written(keys_of(frame, batches=8), "keys")
    runs = LineRuns(buckets=4, fan=3)
    for day in range(8):
        runs = runs.add(keys.filter(F.col("batch") == day))
        assert len(runs.runs) <= 4 and all(len(level) < 3 for level in runs.levels)
    totals = {(r["hi"], r["lo"]): r["n"] for r in runs.common(spark, 1).collect()}
    expected = Counter((r["hi"], r["lo"]) for r in keys.collect())
    assert totals == expected
    assert {tuple(r) for r in runs.common(spark, 10).select("hi", "lo").collect()} == {k for k, n in expected.items() if n >= 10}
    # runs are merged where they lie: only the batch is dealt out
    plans, whole = [], index_lines(keys.filter("batch = 0"))
    monkeypatch.setattr(LineRuns, "_write", lambda self, rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or "none")
    for buckets in (4, 8):
        LineRuns(buckets, runs.levels if buckets == 4 else (whole.runs[:1],), 9).add(keys.filter("batch = 1"))
    assert [p.count("SortMergeJoin") for p in plans] == [len(runs.runs), 1] and [p.count("Exchange hashpartitioning") for p in plans] == [2, 1]


def test_index_outlives_its_session_and_takes_more(spark):
    old = [f"shared line\nown {k}" for k in range(6)]
    new = [f"Shared Line \nnew {k}" for k in range(4)]
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = index_lines(written(keys_of(frame(old)), "keys"))
    for path in first.runs:  # as in a session that does not know the tables
        spark.sql(f"DROP TABLE {path.rsplit('/', 1)[1].replace('-', '_')}")
    keys = written(keys_of(frame(new)), "keys")
    both = index_lines(keys, LineRuns(first.buckets, first.levels, first.fan))
    rows = drop_common_lines(frame(new), keys, both).collect()
    assert sorted(r["text"] for r in rows) == [f"new {k}" for k in range(4)] and {r["n_dropped"] for r in rows} == {1}
    assert {r["n_dropped"] for r in drop_common_lines(frame(old), written(keys_of(frame(old)), "keys"), first).collect()} == {0}


def odd_columns(frame):
    """Columns of all kinds, with names that operators use themselves."""
    extra = {
        "ref": F.lit(1), "more": F.lit("x"), "kept": F.lit(2), "n_lines": F.lit(9), "batch": F.lit(3), "a.b": F.lit(4), "hi": F.lit(5),
        "m": F.create_map(F.lit("k"), F.lit(1)), "t": F.lit("2024-01-01 00:00:00.000999").cast("timestamp_ntz"), "b": F.lit(b"\x00\xff"),
        "s": F.struct(F.array(F.lit(None).cast("int")).alias("x")), "nan": F.lit(float("nan")), "v": F.parse_json(F.lit('{"a":1}')),
    }
    return frame.withColumns({k: v for k, v in extra.items() if k != "v"})


def test_lines_keep_columns_of_all_kinds(spark):
    rows = [(None, "Same\nx"), (None, "same \ny"), (1, "SAME"), (1, "SAME"), (2, None)]
    frame = odd_columns(spark.createDataFrame(rows, "doc_id long, text string"))
    out = dedup_lines(frame, 4)
    assert out.columns == [*[c for c in frame.columns if c != "n_lines"], "n_lines", "n_dropped"]
    got = out.collect()
    assert sorted(("-" if r["text"] is None else r["text"], r["n_lines"], r["n_dropped"]) for r in got) == [("", 1, 1), ("", 1, 1), ("-", 1, 0), ("x", 2, 1), ("y", 2, 1)]
    assert {(r["m"]["k"], r["t"], bytes(r["b"]), r["a.b"]) for r in got} == {(1, datetime(2024, 1, 1, 0, 0, 0, 999), b"\x00\xff", 4)}
    assert dedup_lines(frame.filter("false")).count() == 0


# --- negatives ----------------------------------------------------------------------


def mined(rows: list, asked, positives: int = 5, k: int = 3) -> set:
    whole = {(i, label, tuple(v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    q = {r: [int(np.floor(256 * float(x))) for x in r[2]] for r in whole}
    dot = lambda a, b: sum(x * y for x, y in zip(q[a], q[b], strict=False))
    out = []
    for a in whole:
        if not asked(a[0]):
            continue
        others = sorted((-dot(a, b), b[0], b[1]) for b in whole if b[0] != a[0])
        for s, p, _ in [o for o in others if o[2] == a[1]][:positives]:
            fit = [o for o in others if o[2] != a[1] and 50 * -s <= 100 * -o[0] <= 95 * -s][:k]
            out += [(a[0], p, rank, n, -s, -m) for rank, (m, n, _) in enumerate(fit, 1)]
    return Counter(out)


def test_negatives_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(k, [float(np.float32(rng.gauss(0.1, 0.3))) for _ in range(6)], rng.randrange(4)) for k in range(300)]
    rows += [(300 + k, rows[k % 3][1], k % 3) for k in range(60)]  # ties
    rows += [(50, [0.1] * 6, 2), (50, [0.2] * 6, 2), (7, rows[7][1], 3), rows[9], rows[9]]  # ids that clash, rows that repeat
    rows += [(None, [1.0], 1), (400, None, 1), (401, [None, 1.0], 1), (402, [float("nan")], 1), (403, [float("inf")], 1), (404, [1.0], None), (450, [], 1), (451, [0.5], 1), (500, [0.0], 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("q", F.lit(1)).withColumn("asked", F.lit(False)).withColumn("block", F.lit(3))
    for block_rows in (8192, 37):
        got = mine_negatives(frame, F.col("vec_id") % 50 == 0, block_rows=block_rows).collect()
        assert Counter(map(tuple, got)) == mined(rows, lambda i: i % 50 == 0)
    assert mine_negatives(frame.filter("false"), F.lit(True)).count() == 0 and mine_negatives(frame, F.lit(None).cast("boolean")).count() == 0
    assert mine_negatives(frame.filter("vec_id = 0"), F.lit(True)).count() == 0


def test_scores_are_exact_in_every_range(spark):
    for scale in (1.0, 1e5, 1e10):
        rows = [(k, [scale * (k % 7 - 2), scale * (k % 5), 1.0 + k / 512], k % 2) for k in range(40)]
        values = np.array([[int(np.floor(256 * x)) for x in v] for _, v, _ in rows], object)
        block = Block(40, 3, np.arange(40).tobytes(), np.array([r[2] for r in rows]).tobytes(), values.astype(np.int64).tobytes())
        for k in (0, 3, 39):
            assert [int(s) for s in block.scores(values[k].tolist())] == (values @ values[k]).tolist()
    rows = [(k, [2e6 * (k % 7 - 2), 2e6 * (k % 5), 1.0 + k / 512], k % 3) for k in range(60)]
    got = mine_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") < 5)
    assert Counter(map(tuple, got.collect())) == mined(rows, lambda i: i < 5)


def test_limits_hold_both_ends():
    for score in range(-300, 300):
        upper, lower = limits(score, 50, 95)
        assert {n for n in range(-400, 400) if lower <= n <= upper} == {n for n in range(-400, 400) if 50 * score <= 100 * n <= 95 * score}


# --- sources ------------------------------------------------------------------------


def audited(rows: list, least: int, most: int) -> set:
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    seen: dict = defaultdict(Counter)
    counts: dict = defaultdict(Counter)
    for lang, source, terms in docs:
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        sources = sorted({d[1] for d in docs if d[0] == lang})
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}
        q, ps = p(whole), {s: p(own[s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, rank) for rank, (v, o) in enumerate(pairs, 1)}
            terms = sorted((q[t] - ps[s][t], t.encode()) for t in kept if own[s][t] > 0 and ps[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, rank) for rank, (v, t) in enumerate(terms[:most], 1)}
    return out


@pytest.mark.parametrize("cells", [1 << 20, 40, 1])
def test_sources_against_a_loop(spark, cells):
    rng = random.Random(cells)
    words = ["the", "The", "naïve", "É", "é", "\U0001f493", "x1y", "don't", "漢字", "zz", "\x80", "[a]", "~"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(15))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", None, "", "é", "Z"])) for _ in range(300)]
    rows += [(None, "en", "only-null"), ("", "xx", "p"), (None, "xx", "q"), ("1 2", "xx", "r"), ("alone", "yy", "s"), *[("same same", "en", "copies")] * 40]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("n", F.lit(2)).repartition(7)
    got = audit_sources(frame, 6, 3, tile_cells=cells).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == audited(rows, 6, 3)
    assert audit_sources(frame.filter("false")).count() == 0


def test_terms_are_not_cut(monkeypatch):
    text = "Ab, é漢c d1e  " * 50 + "x" * 100
    whole = [t for part in terms_of(text) for t in part]
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(divergence, "_PIECE", size)
        assert [t for part in terms_of(text) for t in part] == whole
    assert list(terms_of("")) == []


def test_probabilities_of_large_counts_are_exact():
    for counts in ([[0, 1, 7], [3, 0, 2]], [[10**10, 1, 10**13], [5, 10**16, 0]]):
        table = np.array(counts, np.int64)
        got = probabilities(table, table.sum(axis=1), 3)
        assert got.tolist() == [[1 + 10**9 * (c + 5) // (sum(row) + 15) for c in row] for row in counts]


def test_a_task_sends_its_counts_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_HELD_TERMS", 10)
    rows = [(f"w{k % 30} v{chr(97 + k % 26)} same", "en", f"s{k % 3}") for k in range(200)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert {tuple(r) for r in audit_sources(frame, 5, 4).collect()} == audited(rows, 5, 4)
