"""The contract queries: against SQL where it can express them, else against brute force or on held-out rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import same_rows
from tidemark.llm.queries import oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    same_rows(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df())


def test_languages_are_told_on_held_out_rows(spark, sf_dir, documents):
    rows = QUERIES["op1_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(documents)
    held = [r for r in rows if r["held_out"]]
    assert held and len(held) < len(rows)
    right = sum(r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_match_sizes_recomputed_from_the_dictionaries(spark, sf_dir, documents):
    import regex
    import zstandard

    from tidemark.llm.language import fit_languages, identify_languages

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs)
    coders = lambda c: zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
    table = [(coders(large), [coders(c) for c in small]) for large, small in zip(model.large, model.small, strict=True)]
    for r in identify_languages(docs.select("doc_id", "text"), model).collect():
        text = documents[r["doc_id"]]["text"]
        if text is None or not regex.search(r"\p{L}", text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        data = " ".join(regex.findall(r"[\p{L}\p{M}]+", text.lower())).encode()
        blocks = [data[k : k + model.block] for k in range(0, len(data), model.block)]
        sizes = [sum(len(small) * len(large.compress(b)) + sum(len(c.compress(b[: model.head])) for c in small) for b in blocks) for large, small in table]
        first, second = sorted(sizes)[:2]
        assert r["lang_pred"] == model.languages[sizes.index(first)] and r["score"] == (second - first) / second


def fingerprint(text: str, k: int = 3) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fingerprints: dict) -> dict:
    """Smallest id of each document's group, by comparing all pairs."""
    ids = sorted(fingerprints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fingerprints[a] ^ fingerprints[b]).bit_count() <= 3:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark, sf_dir, documents):
    expected = {i: fingerprint(r["text"]) for i, r in documents.items()}
    linked = groups(expected)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash"](spark, sf_dir).collect()}
    assert got == {i: (f"{f:016x}", linked[i]) for i, f in expected.items()}


FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind: str, match: str) -> bool:
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text: str) -> list[str]:
    return [f"{kind}:{m.start()}:{m.end()}" for kind, p in FORMATS.items() for m in re.finditer(p, text or "") if valid(kind, m[0])]


def test_personal_data_matches_brute_force(spark, sf_dir, documents):
    for r in QUERIES["op10_personal_data"](spark, sf_dir).collect():
        expected = base_spans(documents[r["doc_id"]]["text"])
        assert r["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert set(expected) <= set(r["spans"].split(",")) | {""}
        counts = Counter(s.split(":")[0] for s in expected)
        assert [r[f"n_{k}"] for k in FORMATS] == [counts[k] for k in FORMATS]


def repeated_bytes(texts: dict, n: int = 200) -> dict:
    """(bytes, removed, spans, digest of what is kept) by id, from counting every window."""
    data = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(hash(b[k : k + n]) for b in data.values() for k in range(len(b) - n + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[hash(b[k : k + n])] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


def test_suffix_dedup_matches_brute_force(spark, sf_dir, documents):
    expected = repeated_bytes({i: r["text"] for i, r in documents.items()})
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op9_suffix_dedup"](spark, sf_dir).collect()}
    assert any(r[1] for r in expected.values())
    assert got == expected


def test_index_finds_all_links_of_crowded_fingerprints(spark):
    import random

    from tidemark.llm.simhash import near_links

    rnd = random.Random(5)
    values = set()
    for centre in (0, rnd.getrandbits(64), (1 << 64) - 1):
        for _ in range(150):
            v = centre
            for _ in range(rnd.randrange(6)):
                v ^= 1 << rnd.randrange(64)
            values.add(v)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    expected = {(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 3}
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    for limit in (4, 64):
        assert {(r["a"], r["b"]) for r in near_links(frame, limit).collect()} == expected


def test_components_of_chains_and_stars(spark):
    from tidemark.llm.graph import components

    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (300, 200), (None, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100), 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_crowded_anchors_are_counted_exactly(spark):
    import random

    from tidemark.llm.repeats import remove_repeated_bytes

    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    texts = {k: " ".join(word() for _ in range(30)) + passage[: rnd.randrange(150, 350)] + " ".join(word() for _ in range(30)) for k in range(60)}
    texts |= {100: passage, 101: None, 102: "ab" * 300, 103: texts[3], 104: "é" * 150}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for crowd in (3, 4096):
        got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["d"]) for r in remove_repeated_bytes(frame, crowd=crowd).withColumn("d", F.sha2("kept", 256)).collect()}
        assert got == repeated_bytes(texts)
