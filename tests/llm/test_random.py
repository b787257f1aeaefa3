"""Few words and much repetition, against brute force."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_contract import repeated_bytes
from tidemark.llm import mixing, packed, repeats, simhash, substrings
from tidemark.llm.decontamination import find_contamination
from tidemark.llm.repeats import maximal_repeats, remove_repeated_bytes
from tidemark.llm.substrings import remove_repeats


def texts(seed: int, n: int) -> dict[int, str]:
    """Texts over small vocabularies, some of them made of pieces of others."""
    rnd = random.Random(seed)
    out: list[list[str]] = []
    for _ in range(n):
        vocabulary = [f"w{k}" for k in range(rnd.choice((1, 2, 3, 40, 400)))]
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice((0, 1, 12, 13, 19, 20, 21, 60, 150)))]
        if out and rnd.random() < 0.7:
            other = rnd.choice(out)
            start = rnd.randrange(len(other) + 1)
            at = rnd.randrange(len(words) + 1)
            words[at:at] = other[start : start + rnd.randrange(45)]
        out.append(words)
    return {k: " ".join(words) for k, words in enumerate(out)}


def test_fingerprints_of_texts_in_pieces(monkeypatch):
    given = [t.encode() for t in texts(3, 80).values()] + [b"", b" \n", b"x" * 90, b"A\x0bb\x1cc  d e", b"a b " * 700]
    whole = {k: simhash.fingerprints(given, k).tolist() for k in (1, 3, 5)}
    for piece, held in ((1, 1), (4, 7), (50, 100)):
        monkeypatch.setattr(simhash, "PIECE", piece)
        monkeypatch.setattr(simhash, "HELD", held)
        assert {k: simhash.fingerprints(given, k).tolist() for k in whole} == whole


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_few_words(spark, seed, monkeypatch):
    given = texts(seed, 150)
    seen, expected = set(), {}
    for k, text in sorted(given.items()):
        words = text.split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        expected[k] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    frame = spark.createDataFrame(list(given.items()), "doc_id long, text string").repartition(5)
    size = sum(map(len, given.values()))
    for part_bytes, chunk_words in ((size, 2 << 20), (size // 2000, 2 << 20), (size // 2000, 500)):  # small chunks: these and parts grow
        monkeypatch.setattr(substrings, "CHUNK_WORDS", chunk_words)
        got = {r["id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(frame, part_bytes=part_bytes).collect()}
        assert got == expected and any(n for _, n, _ in expected.values())


def test_equal_rows_of_several_partitions_are_one_document(spark):
    one, two = (" ".join(f"{name}{k}" for k in range(30)) for name in "ab")
    given = [(1, one), (2, two + " end"), (3, "c " + two), (None, one + " d")]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(given * 6, 12), "doc_id long, text string")
    expected = {1: (30, 0, one), 2: (31, 0, two + " end"), 3: (31, 30, "c"), None: (31, 30, "d")}
    # joined by broadcast, and by a shuffle
    for limit in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            rows = remove_repeats(frame).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sorted((str(r["id"]), r["n_words"], r["n_removed"], r["kept"]) for r in rows) == sorted((str(k), *expected[k]) for k, _ in given * 6)


@pytest.mark.parametrize("seed", [3, 4])
def test_contamination_with_few_words(spark, seed):
    given, items = texts(seed, 150), {}
    rnd = random.Random(seed)
    for k in range(40):
        words = rnd.choice(list(given.values())).split() + [f"w{rnd.randrange(5)}" for _ in range(rnd.randrange(4))]
        start = rnd.randrange(len(words) + 1)
        items[k] = " ".join(words[start : start + rnd.choice((1, 4, 5, 12, 13, 14, 40))])
    expected = {}
    for d, text in given.items():
        words = text.split()
        hit, found = [False] * len(words), []
        for k, item in items.items():
            own = item.split()
            n = min(13, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
            places = [i for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in windows] if own else []
            for i in places:
                hit[i : i + n] = [True] * n
            found += [str(k)] if places else []
        expected[d] = (len(words), sum(hit), sorted(found), sum(hit) > 0 and 20 * sum(hit) >= len(words))
    docs = spark.createDataFrame(list(given.items()), "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for task_bytes in (16 << 20, 2000):
        rows = find_contamination(docs, bench, task_bytes=task_bytes).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows} == expected


def test_one_fingerprint_in_very_many_items(spark):
    shared = " ".join(f"s{k}" for k in range(8))
    items = {k: f"a{k} b{k} c{k} {shared} d{k % 7} e{k % 7} f{k % 7} g{k}" for k in range(10_000)}
    given = {1: items[5], 2: f"x {shared} y", 3: f"{items[9]} and {items[9]}", 4: f"{shared} d3 e3 f3", 5: f"q {shared} d3 e3 f3 g10 r"}
    docs = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    windows = {}
    for k, item in items.items():
        words = item.split()
        for i in range(len(words) - 12):
            windows.setdefault(tuple(words[i : i + 13]), set()).add(str(k))
    expected = {}
    for d, text in given.items():
        words = text.split()
        places = [i for i in range(len(words) - 12) if tuple(words[i : i + 13]) in windows]
        expected[d] = len({i + j for i in places for j in range(13)}), sorted({n for i in places for n in windows[tuple(words[i : i + 13])]})
    for task_bytes in (16 << 20, 2000):
        rows = find_contamination(docs, bench, task_bytes=task_bytes).collect()
        assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in rows} == expected


def test_maximal_repeats_match_all_pairs():
    rnd = random.Random(6)
    for n, letters in ((2, b"ab"), (30, b"ab"), (60, b"abc"), (25, b"a")):
        group = list({(bytes(rnd.choices(letters, k=rnd.randrange(8))), b"anchor" + bytes(rnd.choices(letters, k=rnd.randrange(8)))) for _ in range(n)})
        agree = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        for window in (7, 9, 12):
            expected = set()
            for a in range(len(group)):
                for b in range(a + 1, len(group)):
                    left, right = agree(group[a][0], group[b][0]), agree(group[a][1], group[b][1])
                    if left + right >= window:
                        expected.add((left, right, frozenset(k for k in range(len(group)) if agree(group[k][0], group[a][0]) >= left and agree(group[k][1], group[a][1]) >= right)))
            got = [(left, right, frozenset(members)) for left, right, members in maximal_repeats(group, window)]
            assert set(got) == expected and len(got) == len(expected)


def test_repeated_bytes_in_two_and_in_very_many_parts(spark, monkeypatch):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(80))
    given = {k: " ".join(word() for _ in range(30)) + passage[: rnd.randrange(150, 400)] + " ".join(word() for _ in range(30)) for k in range(40)}
    frame = spark.createDataFrame(list(given.items()), "doc_id long, text string").repartition(3)
    size = sum(map(len, given.values()))
    for crowd, part_bytes, chunk_bytes in ((4096, size, 8 << 20), (4096, size // 2000, 8 << 20), (3, size // 2000, 8 << 20), (4096, size // 2000, 2000)):
        monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk_bytes)
        rows = remove_repeated_bytes(frame, crowd=crowd, part_bytes=part_bytes).withColumn("d", F.sha2("kept", 256)).collect()
        assert {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["d"]) for r in rows} == repeated_bytes(given)


def test_rows_stay_in_proportion_to_the_text():
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(9000)]
    rows = {"words": [], "bytes": []}
    for parts in (1, 20, 200, 2000):
        docs = [" ".join(rnd.choices(words, k=500)).encode() for _ in range(parts if parts > 1 else 4)]
        frame = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array([bytes(16)] * len(docs)), pa.array([d.decode() for d in docs])], names=["id", "hash", "text"])
        size, part_bytes = sum(map(len, docs)), len(docs[0])
        for name, chunk_keys, made in (
            ("words", 4000, lambda n, grown: substrings._probe_chunks(n, int(4000 * grown))),
            ("bytes", 400, lambda n, grown: repeats._offer_chunks(n, int(400 * grown * repeats._SPACING))),
        ):
            n, grown = packed.sizes(size, 1, chunk_keys, part_bytes)
            rows[name].append(sum(b.num_rows for b in made(n, grown)(iter([frame]))) / size)
    # one part gives fewest rows; from then on a row holds about as many keys however many parts there are
    for per_byte, bytes_a_key in ((rows["words"], 6), (rows["bytes"], repeats._SPACING)):
        assert all(x * bytes_a_key * packed.ROW_KEYS < 2 for x in per_byte)
        assert per_byte[-1] < 1.5 * per_byte[-2]
    # sizes of tables that fit a machine stay as they are
    assert packed.sizes(1 << 40, 200, 2 << 20) == (packed.parts_of(1 << 40, 200), 1.0)
    parts, grown = packed.sizes(100 << 40, 200, 2 << 20)
    assert 5 < grown < 10 and abs(grown * (2 << 20) / parts - packed.ROW_KEYS) < 1


def test_mix_of_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_DOCS", 4)
    monkeypatch.setattr(mixing, "CROWDED", 2)
    monkeypatch.setattr(mixing, "COPIES", 8)
    rng = random.Random(5)
    text = lambda: " ".join(str(rng.randrange(99)) for _ in range(rng.randrange(9)))
    rows = [(None, text(), "a") for _ in range(150)] + [(7, text(), rng.choice("ab")) for _ in range(150)] + [(8, "x y z", "b")] * 50 + [(None, None, None)] * 20 + [(100 + k, text(), rng.choice(["a", "b", None])) for k in range(130)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(frame.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(frame.repartition(3)).collect()))
    ties = frame.withColumn("tie", F.xxhash64("text", "doc_id")).collect()
    quota = {r["source"]: int(r["target"] + 1e-9) for r in got}
    expected = []
    for source in ("a", "b", None):
        stream = sorted((hashlib.md5(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()).hexdigest(), r["tie"], r["doc_id"] or -1, len((r["text"] or "").split())) for r in ties if r["source"] == source)
        whole, at = sum(s for *_, s in stream), 0
        rounds, rest = divmod(quota[source], whole) if whole else (0, 0)
        for _, _, id_, size in stream:
            expected.append((id_, size, whole, size * rounds + max(0, min(size, rest - at))))
            at += size
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in got) == sorted(expected)
