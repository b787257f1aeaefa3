"""Personal data: fixed formats, and candidates that boosted trees choose.

Base spans are what the fixed formats match.  Besides, generators with high
recall propose spans that may overlap; gradient-boosted trees score them by
format and context; thresholds calibrated on held-out candidates select what
is added.

What could be added is by its nature what no fixed format matches, so the
trees can't learn from the formats' own matches alone.  They learn from these rewritten, where they stand, into
spellings that the formats miss (``REWRITTEN``), from made-up secrets, and from made-up digests, identifiers, dates and numbers
that only look like them (``PLANTED``), and from all other candidates that touch no base span.  What is made up carries its
label by how it was made, not by a rule that the trees could repeat; candidates in the text that a name such as "token" speaks for
are left out of training, as what they are is not known.

All of it is DataFrame operations.  The trained trees become one SQL
expression, so that a document is judged where it is read, without a shuffle.
Places and overlaps of matches are told by running sums and neighbours, so the work is near linear in
their number.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import apart, as_one, quoted, without, written

#: Kinds of base spans, in order; and of all spans.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

# Matches are the same as those of the plain formats.  A run of characters is
# entered only where it begins (or where the last match ended) and is never
# given back, as a later start in the same run can't match where the first didn't;
# so the time stays linear in texts with very long runs.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_AT = r"(?:\x20?(?:@|[\[({<]\x20?at\x20?[\])}>])\x20?|\x20at\x20(?=[a-z0-9-]++\x20dot\x20))"
_DOT = r"(?:\x20?(?:\.|[\[({<]\x20?dot\x20?[\])}>])\x20?|\x20dot\x20)"
_MIXED = "A-Za-z0-9_+/-"

#: High-recall generators: written-out addresses, digits in loose groups, dotted numbers, long mixed strings.
GENERATORS = {
    "address": rf"(?i)(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++{_AT}[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)*+",
    "dotted": r"(?i)(?:\G|(?<![0-9]))[0-9]++(?:\x20?(?:[.:]|[\[(]\x20?(?:\.|dot)\x20?[\])])\x20?[0-9]++){3}+",
    "number": r"[+(]?[0-9]++(?:[\x20()./_-]{1,3}[0-9]++)*+",
    "secret": rf"(?<![{_MIXED}])[{_MIXED}]{{16,}}+",
}

#: What a text must hold for a format or generator to be tried.
_NEEDS = {
    "email": "@",
    "ip": "[0-9]",
    "card": "[0-9]",
    "phone": r"\+[0-9]",
    "address": r"(?i)@|[\[({<]\x20?at\x20?[\])}>]|\x20at\x20[a-z0-9-]++\x20dot\x20",
    "number": "[0-9]",
    "dotted": "[0-9]",
    "secret": "[0-9][A-Za-z]|[A-Za-z][0-9]",
}
_NEEDS_ANY = r"(?i)[0-9@]|[\[({<]\x20?at\x20?[\])}>]|\x20at\x20[a-z0-9-]++\x20dot\x20"

# Words before a span that speak for or against it, and names that secrets are assigned to.
_FOR = r"(?i)(?:mail|contact|write|phone|tel|call|fax|mobile|card|visa|account|host|server|address|ip)\W*$"
_AGAINST = r"(?i)(?:version|v|ver|isbn|issn|pages?|pp|no|nr|chapter|section|id|uuid|commit|sha\d*|md5|digest|checksum|etag|date|order|invoice|build|rev(?:ision)?|since|on)\W*$"
_NAMED = r"(?i)(?:token|secret|password|passwd|credential|api[_-]?key|access[_-]?key|private[_-]?key)\W*$"
_ASSIGNED = r"[:=]\s*[\"'`]?$"

#: Code points around a match that are looked at.
_AROUND = 24

#: Candidates at most that are drawn for training, and examples of each sort below which nothing is learnt.
SAMPLE = 8192
LEAST = 100

#: Code points of the pieces from which a long text is put together again.
_PIECE = 1024

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LAST = (1 << 31) - 1


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value computed once; unlike ``transform``, a fold over nothing copies no value."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, f)


def _running(values: Column, op: Callable[[Column, Column], Column], none: int) -> Column:
    """What ``op`` makes of each number and all before it, by doubling the reach: an array that grows row by row would be copied row by row."""

    def double(acc: Column, step: Column) -> Column:
        return F.transform(acc, lambda v, i: op(v, F.coalesce(F.get(acc, i - step), F.lit(none))))

    def run(v: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1), lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.when(F.size(v) > 1, F.aggregate(steps, v, double)).otherwise(v)

    return _let(values.cast("array<int>"), run)


# --- matches ----------------------------------------------------------------------


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """16 to 19 digits whose sum, every second from the right doubled, ends in zero."""
    d = _digits(m)
    n = F.length(d)

    def worth(i: Column) -> Column:
        v = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, v).when(v > 4, v * 2 - 9).otherwise(v * 2)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, b: a + b)
    return F.when(n.between(16, 19), total % 10 == 0).otherwise(F.lit(False))


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
    "address": lambda m: F.lit(True),
    "number": lambda m: F.length(_digits(m)).between(7, 19),
    "dotted": lambda m: F.lit(True),
    "secret": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
}

_FOUND = "struct<start:int,end:int,m:string,before:string,after:string>"


def _found(text: Column, kind: str) -> Column:
    """Valid matches in order: start, end (code points), match, and some text before and after."""
    pattern = {**BASE, **GENERATORS}[kind]

    def placed(x: Column) -> Column:
        """From the matches and the texts between them."""
        lengths = F.transform(x["matches"], lambda m, i: F.length(F.get(x["gaps"], i)) + F.length(m))
        return _let(_running(lengths, lambda a, b: a + b, 0), lambda ends: F.transform(x["matches"], lambda m, i: one(x["gaps"], m, i, F.get(ends, i))))

    def one(gaps: Column, m: Column, i: Column, end: Column) -> Column:
        sides = F.right(F.get(gaps, i), F.lit(_AROUND)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(_AROUND)).alias("after")
        return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("m"), *sides)

    def valid(x: Column) -> Column:
        return F.filter(placed(x), lambda s: _VALID[kind](s["m"]))

    none = F.array().cast(f"array<{_FOUND}>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = _let(matches, lambda ms: F.when(F.size(ms) > 0, _let(F.struct(F.split(text, pattern, -1).alias("gaps"), ms.alias("matches")), valid)).otherwise(none))
    return F.when(text.rlike(_NEEDS[kind]), found).otherwise(none).cast(f"array<{_FOUND}>")


def _of_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "m", "before", "after")]))


def _base(text: Column) -> Column:
    """All base matches, by kind and start."""
    return F.concat(*[_of_kind(_found(text, k), k) for k in KINDS])


def _candidates(text: Column) -> Column:
    """All that the generators propose."""
    return F.concat(*[_of_kind(_found(text, k), k) for k in GENERATORS])


def count_of(spans: Column, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


# --- features ---------------------------------------------------------------------


def _class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)


def _count(m: Column, what: str) -> Column:
    return F.regexp_count(m, F.lit(what))


def _unless_number(c, count: Column) -> Column:
    """Which separators a number has is not looked at, so that it counts the same with one that was never seen."""
    return F.when(c["kind"] == "number", 0).otherwise(count)


#: Features by name, from a candidate.
FEATURES = {
    "address": lambda c: (c["kind"] == "address").cast("int"),
    "dotted": lambda c: (c["kind"] == "dotted").cast("int"),
    "secret": lambda c: (c["kind"] == "secret").cast("int"),
    "length": lambda c: _unless_number(c, F.length(c["m"])),
    "digits": lambda c: _count(c["m"], "[0-9]"),
    "letters": lambda c: _count(c["m"], r"\p{L}"),
    "dots": lambda c: _unless_number(c, _count(c["m"], r"\.")),
    "spaces": lambda c: _unless_number(c, _count(c["m"], r"[\x20-]")),
    "brackets": lambda c: _count(c["m"], r"[()\[\]{}<>]"),
    "slashes": lambda c: _unless_number(c, _count(c["m"], "/")),
    "capitals": lambda c: _count(c["m"], "[A-Z]"),
    "hex": lambda c: c["m"].rlike("^[0-9a-f-]+$|^[0-9A-F-]+$").cast("int"),
    "changes": lambda c: _count(c["m"], "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
    "fours": lambda c: c["m"].rlike("^[0-9]{4}(?:[^0-9]+[0-9]{4})+$").cast("int"),
    "groups": lambda c: _count(c["m"], "[0-9]+"),
    "first_group": lambda c: F.length(F.regexp_extract(c["m"], "[0-9]+", 0)),
    "last_group": lambda c: F.length(F.regexp_extract(c["m"], "([0-9]+)[^0-9]*$", 1)),
    "at": lambda c: c["m"].rlike("(?i)@|at").cast("int"),
    "dot_words": lambda c: _count(c["m"], r"(?i)[\x20\[(]dot[\x20\])]"),
    "octets": lambda c: c["m"].rlike(rf"^{_OCTET}(?:[^0-9]+{_OCTET}){{3}}$").cast("int"),
    "checksum": lambda c: _luhn(c["m"]).cast("int"),
    "left": lambda c: _class(F.right(c["before"], F.lit(1))),
    "right": lambda c: _class(c["after"]),
    "for": lambda c: c["before"].rlike(_FOR).cast("int"),
    "against": lambda c: c["before"].rlike(_AGAINST).cast("int"),
    "named": lambda c: F.regexp_replace(c["before"], _ASSIGNED, "").rlike(_NAMED).cast("int"),
    "assigned": lambda c: c["before"].rlike(_ASSIGNED).cast("int"),
}


def _features(c) -> list[Column]:
    return [f(c).cast("int").alias(f"f{k}") for k, f in enumerate(FEATURES.values())]


# --- boosted trees ----------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """Nested (feature, split, low, high) or a leaf's value, with weights; and by generator the threshold on their weighted sum."""

    trees: tuple = ()
    weights: tuple[float, ...] = ()
    thresholds: dict[str, float] = field(default_factory=dict)

    def margin(self, c) -> Column:
        def value(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, split, low, high = node
            return F.when(c[f"f{feature}"] <= split, value(low)).otherwise(value(high))

        out = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            out = out + value(tree) * weight
        return out

    def passes(self, kind: Column, margin: Column) -> Column:
        """Whether a candidate is at or over its generator's threshold."""
        out = F.lit(False)
        for own, threshold in self.thresholds.items():
            out = out | ((kind == own) & (margin >= threshold))
        return out


def _read_tree(lines: list[str]):
    """One tree from the lines in which Spark prints it."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    feature, split = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _read_tree(lines)
    lines.pop(0)
    return int(feature), float(split), low, _read_tree(lines)


def _grouped(m: Column, by: str) -> Column:
    """Digits in fours."""
    return F.regexp_replace(_digits(m), "([0-9]{4})(?=[0-9])", f"$1{by}")


def _spelled(m: Column, at: str, dot: str) -> Column:
    parts = F.split(m, "@", 2)
    return F.concat(parts[0], F.lit(at), F.replace(parts[1], F.lit("."), F.lit(dot)))


#: Spellings of a base match that no fixed format matches whole, and the generator that should propose them.
REWRITTEN: dict[str, tuple[str, Callable[[Column], list[Column]]]] = {
    "email": ("address", lambda m: [_spelled(m, "[at]", "[dot]"), _spelled(m, " [at] ", " [dot] "), _spelled(m, " (at) ", " (dot) "), _spelled(m, " {at} ", " {dot} "), _spelled(m, " at ", " dot "), _spelled(m, " @ ", " . "), _spelled(m, "(at)", ".")]),
    "ip": ("dotted", lambda m: [F.replace(m, F.lit("."), F.lit(by)) for by in ("[.]", "(dot)", " . ", "[dot]")]),
    "card": ("number", lambda m: [_grouped(m, by) for by in (".", "/", " - ", "  ", "_")]),
    "phone": (
        "number",
        lambda m: [
            F.expr("substring(m, 2)"),
            F.concat(F.lit("00"), F.expr("substring(m, 2)")),
            F.regexp_replace(F.expr("substring(m, 2)"), "[^0-9]+", "."),
            F.regexp_replace(F.expr("substring(m, 2)"), "[^0-9]+", "/"),
            F.regexp_extract("m", r"\(.*$", 0),
        ],
    ),
}


def _mixed(h: Column, n: int) -> Column:
    """Letters of both cases and digits, from a hash in hex."""
    return F.left(F.regexp_replace(F.base64(F.unhex(F.concat(h, F.reverse(h)))), "[^A-Za-z0-9]", ""), F.lit(n))


def _numeral(h: Column, start: int, n: int) -> Column:
    return F.substring(F.translate(h, "abcdef", "123456"), start, n)


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _date(h: Column, by: str) -> Column:
    two = lambda at, most: F.lpad((F.conv(F.substring(h, at, 2), 16, 10).cast("int") % most + 1).cast("string"), 2, "0")
    return _joined("20", F.lpad((F.conv(F.substring(h, 7, 2), 16, 10).cast("int") % 40).cast("string"), 2, "0"), by, two(1, 12), by, two(3, 28))


#: What is made up from a hash in hex, by generator and label: what stands before it (nothing: what stood there anyway), and strings.
PLANTED: list[tuple[str, int, tuple[str, ...], tuple[Callable[[Column], Column], ...]]] = [
    ("secret", 1, ("", "token: ", 'api_key = "', "password=", "secret: '", "Bearer "), (lambda h: _mixed(h, 24), lambda h: _mixed(h, 40), lambda h: _joined("sk-", _mixed(h, 32)), lambda h: _joined("ghp_", _mixed(h, 36)), lambda h: _joined("AKIA", F.upper(_mixed(h, 16))))),
    # digits of a hash are a secret where they are called one
    ("secret", 1, ('token = "', "api_key: ", "password=", "secret = '", "access key: ", "credential "), tuple(lambda h, n=n: F.left(h, F.lit(n)) for n in (24, 32, 40, 64))),
    ("secret", 0, ("", "commit ", "sha256: ", "md5=", "uuid: ", 'etag: "', "id=", "file "), (*(lambda h, n=n: F.left(h, F.lit(n)) for n in (24, 32, 40, 64)), lambda h: F.regexp_replace(F.left(h, F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), lambda h: _joined("src/part", _numeral(h, 1, 2), "/main/page", _numeral(h, 3, 1)), lambda h: _joined("release-notes-v", _numeral(h, 1, 1), "-", _numeral(h, 2, 2)))),
    ("number", 0, ("ISBN ", "isbn: ", ""), (lambda h: _joined("978-", F.regexp_replace(_numeral(h, 1, 10), "^(.)(..)(.{6})", "$1-$2-$3-")),)),
    ("number", 0, ("order ", "order no. ", "invoice ", ""), (lambda h: _joined(_date(h, ""), "-", _numeral(h, 9, 7)), lambda h: _joined(_numeral(h, 1, 4), "-", _numeral(h, 5, 6)), lambda h: _numeral(h, 1, 9))),
    ("number", 0, ("date ", "on ", "since ", ""), (lambda h: _joined(_date(h, "-"), " ", _numeral(h, 9, 2)), lambda h: _date(h, "-"), lambda h: _date(h, "/"), lambda h: _joined(_date(h, "."), " - ", _date(F.reverse(h), ".")))),
    ("number", 0, ("pp. ", "pages ", "no. ", "id ", ""), (lambda h: _joined(_numeral(h, 1, 4), "-", _numeral(h, 5, 4)), lambda h: _numeral(h, 1, 13), lambda h: _joined(_numeral(h, 1, 3), "/", _numeral(h, 4, 5)))),
    ("dotted", 0, ("at ", "version ", "build ", ""), (lambda h: F.regexp_replace(_numeral(h, 1, 9), "^(..)(..)(..)", "$1:$2:$3:"), lambda h: _joined("3", F.regexp_replace(_numeral(h, 1, 10), "^(...)(..)(....)", "$1.$2.$3.")))),
    # digits of cards in fours are no address of a host
    ("dotted", 0, ("card ", ""), (lambda h: _joined("4", F.regexp_replace(_numeral(h, 1, 15), "^(...)(....)(....)", "$1.$2.$3.")),)),
]


def _drawn(docs: DataFrame, text_col: str, sample: int) -> DataFrame:
    """(kind, range, m, before, after) of base matches and of candidates that touch none: one for each kind and hash range."""
    text = F.col(quoted(text_col))
    ranges = sample // (len(KINDS) + len(GENERATORS))
    both = docs.filter(text.rlike(_NEEDS_ANY)).select(_base(text).alias("base"), _candidates(text).alias("all"))
    cells = both.select(F.explode(F.concat("base", _free(F.col("base"), F.col("all"), _CANDIDATE))).alias("c")).select("c.*")
    return (
        cells.withColumn("h", F.xxhash64("m", "before"))
        .groupBy("kind", F.pmod("h", F.lit(ranges)).alias("range"))
        .agg(F.min_by(F.struct("m", "before", "after"), "h").alias("s"))
        .select("kind", "range", "s.*")
    )


def _strings(drawn: DataFrame, rewritten: Mapping) -> DataFrame:
    """(range, kind, y, before, v, after): rewritten and made-up strings ``v``, and the generator that should propose them."""
    out = None
    for kind, (generator, spellings) in rewritten.items():
        spelled = drawn.filter(F.col("kind") == kind).select("range", F.lit(generator).alias("kind"), F.lit(1).alias("y"), "before", F.explode(F.array(*spellings(F.col("m")))).alias("v"), "after")
        out = spelled if out is None else out.unionByName(spelled)
    hashed = drawn.select("range", "before", "after", F.sha2(F.concat("kind", "m", "before"), 256).alias("h"))

    def one(k: int, salt: str, of: Sequence[Column]) -> Column:
        """One of some values, by hash."""
        return F.get(F.array(*of), F.pmod(F.xxhash64("h", F.lit(f"{salt}{k}")), F.lit(len(of))).cast("int"))

    made = []
    for k, (generator, y, befores, makes) in enumerate(PLANTED):
        made.append(F.struct(F.lit(generator).alias("kind"), F.lit(y).alias("y"), one(k, "before", [F.lit(b) for b in befores]).alias("b"), one(k, "string", [make(F.col("h")) for make in makes]).alias("v")))
    each = hashed.select("range", "before", "after", F.explode(F.array(*made)).alias("p"))
    before = F.when(F.col("p.b") == "", F.col("before")).otherwise(F.right(F.concat("before", F.lit(" "), "p.b"), F.lit(_AROUND)))
    return out.unionByName(each.select("range", "p.kind", "p.y", before.alias("before"), "p.v", "after")).filter("v <> ''")


def training_rows(drawn: DataFrame, rewritten: Mapping = REWRITTEN) -> DataFrame:
    """(range, kind, y, features) from drawn matches: rewritten and made-up ones that a generator proposes as they are, and the other candidates."""
    named = (F.col("kind") == "secret") & F.regexp_replace("before", _ASSIGNED, "").rlike(_NAMED)
    kept = drawn.filter(F.col("kind").isin(*GENERATORS) & ~named)
    out = kept.select("range", "kind", F.lit(0).alias("y"), "m", "before", "after")
    strings = written(_strings(drawn, rewritten), "strings")
    for generator in GENERATORS:
        found = strings.filter(F.col("kind") == generator).select("range", "kind", "y", "before", "v", F.explode(_found(F.concat("before", "v", "after"), generator)).alias("c"))
        whole = found.filter((F.col("c.start") == F.length("before")) & (F.col("c.end") == F.length("before") + F.length("v")))
        out = out.unionByName(whole.select("range", "kind", "y", "c.m", "c.before", "c.after"))
    out = written(out, "proposed")  # so that the driver plans one step at a time
    return out.select("range", "kind", "y", *_features({c: F.col(c) for c in ("kind", "m", "before", "after")}))


def fit_trees(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, precision: float = 0.98, rounds: int = 12, depth: int = 5, rewritten: Mapping = REWRITTEN) -> Trees:
    """Trees and thresholds from at most ``sample`` matches of ``docs``.

    Of each kind of base match and each generator's candidates one is drawn from each of
    ``sample`` / 8 hash ranges of what it and what stands before it look like, so reruns agree
    and repeated passages count once.  Three quarters of the ranges train; on the rest the threshold of
    each generator becomes the least margin from which on ``precision`` of the candidates are
    rewritten matches or made-up secrets (those with equal margins stand or fall together).  A generator without such
    candidates adds nothing; without enough examples of both sorts nothing is ever added.
    """
    names = [f"f{k}" for k in range(len(FEATURES))]
    drawn = written(_drawn(docs, text_col, sample), "candidates")
    rows = written(training_rows(drawn, rewritten), "examples")
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows.repartition(2, "range"))
    train, held = rows.filter("range % 4 <> 3"), rows.filter("range % 4 = 3")
    if min((r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()), default=0) < LEAST or train.select("y").distinct().count() < 2:
        return Trees()
    model = GBTClassifier(labelCol="y", maxIter=rounds, maxDepth=depth, seed=1).fit(train)
    trees = Trees(tuple(_read_tree([x for x in t.toDebugString.splitlines()[1:] if x.strip()]) for t in model.trees), tuple(model.treeWeights))
    scored = held.select("kind", "y", trees.margin({n: F.col(n) for n in names}).alias("margin"))
    thresholds: dict[str, float] = {}
    counts: dict[str, tuple[int, int]] = {}
    for r in scored.groupBy("kind", "margin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy(F.desc("margin")).collect():
        seen, right = counts.get(r["kind"], (0, 0))
        counts[r["kind"]] = seen, right = seen + r["n"], right + r["y"]
        if right >= precision * seen:
            thresholds[r["kind"]] = r["margin"]
    return Trees(trees.trees, trees.weights, thresholds)


# --- spans ------------------------------------------------------------------------


_CANDIDATE = "struct<kind:string,start:int,end:int,m:string,before:string,after:string>"
_CHOSEN = "struct<start:int,end:int,kind:string,by:string>"
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _free(taken: Column, candidates: Column, of: str) -> Column:
    """The candidates, of type ``of``, that overlap none of the spans taken, by place.

    In order of their starts, a candidate overlaps an earlier span if one reaches beyond its start,
    and a later one if the next starts before its end; no pairs are made.
    """
    row = lambda s, c: F.struct(s["start"].alias("start"), s["end"].alias("end"), c.alias("c")).cast(f"struct<start:int,end:int,c:{of}>")

    def alone(rows: Column) -> Column:
        reach = _running(F.transform(rows, lambda x: F.when(x["c"].isNull(), x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), 0)
        next_ = F.reverse(_running(F.reverse(F.transform(rows, lambda x: F.when(x["c"].isNull(), x["start"]).otherwise(_LAST))), lambda a, b: F.least(a, b), _LAST))
        held = lambda e: F.filter(rows, lambda x, i: x["c"].isNotNull() & (x["start"] >= F.get(e["reach"], i)) & (x["end"] <= F.get(e["next"], i)))
        return F.transform(_let(F.struct(reach.alias("reach"), next_.alias("next")), held), lambda x: x["c"])

    rows = F.array_sort(F.concat(F.transform(taken, lambda s: row(s, F.lit(None))), F.transform(candidates, lambda s: row(s, s))))
    return F.when((F.size(candidates) == 0) | (F.size(taken) == 0), candidates).otherwise(_let(rows, alone))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).cast(_SPANS)


def find_pii(docs: DataFrame, trees: Trees, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with base_spans and spans, arrays of (kind, start, end); without the text unless ``keep_text``.

    Offsets are code points, ends are exclusive.  ``base_spans`` stand by kind as
    in ``KINDS``, then start.  ``spans``, by ``ALL_KINDS``, then start, are these and the candidates at or over
    their generator's threshold that overlap no base span; margins of different generators are not
    calibrated against each other, so where these overlap the first in ``GENERATORS`` stays.  Written-out
    addresses count as email, dotted numbers as ip, numbers of 16 digits and more as card, others as phone,
    mixed strings as secret.  Null and empty texts have no spans; texts are searched as a
    whole.  Repeated rows get equal answers.  Input columns with the name of a
    computed one are dropped, all others stay whatever they are called.  An empty table gives no rows.
    """
    keep = without(docs, ("base_spans", "spans", *(() if keep_text else (text_col,))))
    text = F.coalesce(F.col("text"), F.lit(""))
    likely = text.rlike(_NEEDS_ANY)
    rows = docs.select(as_one(keep), F.col(quoted(text_col)).alias("text"))
    none = F.array().cast(_SPANS)
    base = F.when(likely, _plain(_base(text))).otherwise(none).alias("base_spans")
    if not trees.trees:
        return rows.select("kept", base).select(*apart(keep), "base_spans", F.col("base_spans").alias("spans"))

    def scored(c: Column) -> Column:
        digits, checksum = (f"f{list(FEATURES).index(n)}" for n in ("digits", "checksum"))

        def judged(f: Column) -> Column:
            kind = F.when(c["kind"] == "address", "email").when(c["kind"] == "dotted", "ip").when(c["kind"] == "secret", "secret").when((f[checksum] == 1) | (f[digits] >= 16), "card").otherwise("phone")
            passed = _let(trees.margin(f), lambda m: trees.passes(c["kind"], m))
            return F.struct(c["start"].alias("start"), c["end"].alias("end"), F.when(passed, kind).alias("kind"), c["kind"].alias("by")).cast(_CHOSEN)

        return _let(F.struct(*_features(c)), judged)

    chosen = F.filter(F.transform(_candidates(text), scored), lambda c: c["kind"].isNotNull())
    rows = rows.select("kept", base, F.when(likely, chosen).alias("chosen"))

    def added(taken: Column, generators: list[str]) -> Column:
        """What is taken with what the generators add, one after the other."""
        if not generators:
            return taken
        own = F.filter("chosen", lambda c: c["by"] == generators[0])
        return _let(F.concat(taken, _plain(_let(own, lambda c: _free(taken, c, _CHOSEN)))), lambda more: added(more, generators[1:]))

    rank = F.array(*map(F.lit, ALL_KINDS))
    keyed = F.transform(added(F.col("base_spans"), list(GENERATORS)), lambda s: F.struct(F.array_position(rank, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.when(F.size("chosen") > 0, _plain(F.array_sort(keyed))).otherwise(F.col("base_spans"))
    return rows.select("kept", "base_spans", spans.alias("spans")).select(*apart(keep), "base_spans", "spans")


def redact(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in capitals and brackets; spans that overlap become one, named by the first.

    Null text stays null, text without spans stays as it is.  All columns stay, whatever they are called;
    repeated rows get equal answers.  An empty table gives no rows.
    """
    held = docs.select(as_one(docs.columns), F.col(quoted(text_col)).alias("text"))
    spans = find_pii(held, trees, "text", keep_text=True)
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cover(rows: Column) -> Column:
        """Disjoint stretches: one begins where no span before reaches, and ends where the spans before the next do."""
        reach = _running(F.transform(rows, lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0)

        def joined(r: Column) -> Column:
            before = F.transform(rows, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.coalesce(F.get(r, i - 1), F.lit(0)).alias("at")))
            heads = F.filter(before, lambda h: h["start"] >= h["at"])
            return _let(heads, lambda hs: F.transform(hs, lambda h, i: F.struct(h["start"].alias("start"), F.coalesce(F.get(hs, i + 1)["at"], F.element_at(r, -1)).alias("end"), h["kind"].alias("kind"))))

        return _let(reach, joined)

    def rebuilt(x: Column) -> Column:
        """The text from its pieces and the cover."""

        def between(start: Column, end: Column) -> Column:
            first = F.floor(start / _PIECE).cast("int")
            last = F.floor((end - 1) / _PIECE).cast("int")
            some = F.when(first == last, F.get(x["pieces"], first)).otherwise(F.array_join(F.slice(x["pieces"], first + 1, last - first + 1), ""))
            return F.when(end > start, F.substring(some, start - first * _PIECE + 1, end - start)).otherwise("")

        before = lambda i: F.coalesce(F.get(x["cover"], i - 1)["end"], F.lit(0))
        parts = F.transform(x["cover"], lambda s, i: F.concat(between(before(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), between(F.element_at(x["cover"], -1)["end"], F.length("text")))

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    clean = F.when(F.size("spans") > 0, _let(F.struct(pieces.alias("pieces"), _let(by_start, cover).alias("cover")), rebuilt)).otherwise(F.col("text"))
    return spans.select("kept", clean.alias("text")).select(*[F.col("text").alias(c) if c.lower() == text_col.lower() else F.col("kept").getField(c).alias(c) for c in docs.columns])


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
