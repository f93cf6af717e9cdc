"""Personal data in texts: fixed patterns, and bootstrapped contexts that discover further identifiers.

Everything is made of DataFrame and SQL functions. Java's possessive quantifiers keep the patterns linear and off the
stack on texts of any length; each is equal to the greedy form that the docstring of `base_spans` gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import written

KINDS = ("email", "ip", "card", "phone", "context")

# The four base patterns, as (quick test, pattern). \G keeps what may follow a match right away.
_PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "context": (r"[0-9]", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,16}[0-9])[A-Za-z0-9_-]{8,64}(?![A-Za-z0-9_-])"),
}
_IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
_MARK = "struct<start:int,end:int,left:string,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, b: a + b)
    return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


_VALID = {
    "email": lambda value: F.lit(True),
    "ip": lambda value: value.rlike(_IP),
    "card": lambda value: _luhn(_digits(value)),
    "phone": lambda value: F.length(_digits(value)).between(9, 15),
    "context": lambda value: F.length(_digits(value)) >= 4,
}


def _marks(docs: DataFrame) -> DataFrame:
    """Adds an array of marks (start, end, the text left of it, the match) for each kind, in code points."""
    found = docs.select(
        "*",
        *(F.when(F.col("text").rlike(quick), F.regexp_extract_all("text", F.lit(pattern), 0)).alias(f"{kind}_found") for kind, (quick, pattern) in _PATTERNS.items()),
        *(F.when(F.col("text").rlike(quick), F.split("text", pattern, -1)).alias(f"{kind}_pieces") for kind, (quick, pattern) in _PATTERNS.items()),
    )

    def placed(kind: str) -> Column:
        def mark(x: Column) -> Column:
            start = x["start"] + F.length(x["piece"])
            return F.struct(start.alias("start"), (start + F.length(x["found"])).alias("end"), F.substring(x["piece"], -64, 64).alias("left"), x["found"].alias("value"))

        marks = F.transform(F.arrays_zip(F.col(f"{kind}_found").alias("found"), F.col(f"{kind}_pieces").alias("piece"), F.col(f"{kind}_starts").alias("start")), mark)
        return F.coalesce(F.filter(marks, lambda m: m["value"].isNotNull() & _VALID[kind](m["value"])), F.array().cast(f"array<{_MARK}>"))

    def lengths(kind: str) -> Column:
        return F.zip_with(f"{kind}_found", f"{kind}_pieces", lambda found, piece: F.length(found) + F.length(piece))

    started = found.select("*", *(_before(lengths(kind)).alias(f"{kind}_starts") for kind in KINDS))
    return started.select(*docs.columns, *(placed(kind).alias(kind) for kind in KINDS))


def _before(numbers: Column, block: int = 256) -> Column:
    """The sum of all numbers before each."""
    return _scanned(F.coalesce(numbers, F.array().cast("array<int>")), lambda a, x: a + F.coalesce(x, F.lit(0)), block)


def _scanned(numbers: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """What `step`, from 0 on, makes of all numbers before each, in blocks: an array that grows is copied at every step, so it has to stay short."""

    def running(xs: Column, first: Column) -> Column:
        zero = F.struct(first.alias("sum"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct(step(acc["sum"], x).alias("sum"), F.array_append(acc["all"], acc["sum"]).alias("all")), lambda acc: acc["all"])

    blocks = _blocks(numbers, "array<array<int>>", block)
    sums = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), step))
    return F.when(F.size(numbers) <= block, running(numbers, F.lit(0))).otherwise(F.flatten(F.zip_with(blocks, running(sums, F.lit(0)), running)))


def _blocks(xs: Column, kind: str, block: int) -> Column:
    """An array cut into arrays of `block` elements."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, block))
    return F.when(F.size(xs) > 0, cut).otherwise(F.array().cast(kind))


def _typed(kind: str) -> Column:
    return F.transform(F.col(kind), lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["left"].alias("left"), m["value"].alias("value")))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (md5 of the text), marks: all matches of the base patterns that hold, and candidates (kind 4).

    Base patterns, leftmost and non-overlapping for each kind: email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`;
    ip `[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)` with parts up to 255; card `[0-9]([\\x20-]?[0-9])+` with 13 to 19 digits that
    pass Luhn's test; phone `\\+[0-9][\\x20().0-9-]+[0-9]` with 9 to 15 digits. Candidates are words of 8 to 64 letters,
    digits, `_` and `-` with four digits or more, the first of them within 17 characters.
    Null texts count as empty. Rows stay one for one, whatever their ids.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _marks(rows.withColumn("text_key", F.md5(F.col("text").cast("binary")))).select("doc_id", "text_key", F.concat(*(_typed(k) for k in KINDS)).alias("marks"))


def _contexts(left: Column) -> Column:
    """Patterns that the text before a mark induces: what touches it, and that with the two words before."""
    left = F.regexp_replace(F.lower(left), "[0-9]+", "0")
    touching = F.regexp_extract(left, r"(\S*)$", 1)
    two = F.regexp_extract(left, r"(?:^|\s)(\S{1,24}\s+\S{1,24}\s+\S{0,24})$", 1)
    return F.filter(F.array(F.when(F.length(touching) >= 3, F.concat(F.lit("="), touching)), F.when(two != "", F.regexp_replace(two, r"\s+", " "))), lambda x: x.isNotNull())


def _shape(value: Column) -> Column:
    """Length and marks of a value that looks drawn at random: 16 characters or more, letters and digits both a seventh of it or more; null for others."""
    letters, digits = (F.length(F.regexp_replace(value, f"[^{kind}]", "")) for kind in ("a-z", "0-9"))
    random = (F.length(value) >= 16) & (7 * letters >= F.length(value)) & (7 * digits >= F.length(value))
    return F.when(random, F.concat_ws(":", F.length(value), F.regexp_replace(value, "[a-z0-9]", "")))


def _shaped(edges: DataFrame, distinct: int, share: float) -> DataFrame:
    """value: those behind contexts that stand before `distinct` values or more of one shape, and before few others.

    Of such a context, `share` of its distinct values have the shape, and half as many beginnings (three characters) as values
    are distinct, as numbers in a row wouldn't have. These are seeds beside those of the base patterns.
    """
    beginnings = edges.groupBy("context", _shape(F.col("value")).alias("shape"), F.substring("value", 1, 3).alias("start")).agg(F.count("*").alias("n"))
    shapes = beginnings.groupBy("context", "shape").agg(F.sum("n").alias("n"), F.count("*").alias("starts"))
    best = shapes.groupBy("context").agg(F.max(F.when(F.col("shape").isNotNull(), F.struct("n", "starts", "shape"))).alias("best"), F.sum("n").alias("all"))
    fine = best.where((F.col("best.n") >= distinct) & (F.col("best.n") >= share * F.col("all")) & (2 * F.col("best.starts") >= F.col("best.n")))
    return edges.withColumn("shape", _shape(F.col("value"))).join(fine.select("context", "best.shape"), ["context", "shape"], "left_semi").select("value").distinct()


def learned_spans(base: DataFrame, rounds: int = 2, support: int = 3, confidence: float = 0.5, distinct: int = 5, share: float = 0.8) -> DataFrame:
    """text_key, added: spans (kind 4, start, end) that high-confidence contexts discover; only texts that have any.

    base: the table of `base_spans`. Seeds are the values that base patterns found, and those that `distinct` and `share` make
    seeds (see `_shaped`). A bipartite graph joins each context to the distinct values seen behind it. In each round a context's score is the sum of its values' scores over their
    number and one, and counts if `support` values score; a value that is no seed scores 1 - product of (1 - score) over
    its contexts. A candidate is added where a context of at least `confidence` stands before it and no base span
    overlaps it. Each distinct text counts once, so groups of copies give no weight, and all steps aggregate by key.
    """
    kinds = len(KINDS) - 1
    texts = base.where(F.size("marks") > 0).groupBy("text_key").agg(F.first("marks").alias("marks"))
    every = texts.select("text_key", F.explode("marks").alias("m")).select("text_key", "m.*")
    ahead, back = (Window.partitionBy("text_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in (("start", "kind"), (F.desc("start"), F.desc("kind"))))
    seed = F.col("kind") < kinds  # both windows grow with each row; one that shrinks is summed anew for every row
    every = every.select("*", F.max(F.when(seed, F.col("end"))).over(ahead).alias("before"), F.min(F.when(seed, F.col("start"))).over(back).alias("after"))
    free = F.coalesce(F.col("before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))
    marks = written(every.where(seed | free).select("text_key", "kind", "start", "end", F.lower("value").alias("value"), _contexts(F.col("left")).alias("contexts")), "pii-marks")
    edges = written(marks.select(F.explode("contexts").alias("context"), "value", "kind").groupBy("context", "value").agg((F.min("kind") < kinds).alias("seed")), "pii-found")
    more = _shaped(edges, distinct, share).withColumn("shaped", F.lit(True))
    edges = written(edges.join(more, "value", "left").select("context", "value", (F.col("seed") | F.col("shaped").isNotNull()).alias("seed")), "pii-edges")

    values = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    scored = None
    for _ in range(rounds):
        scored = written(
            edges.join(values, "value").groupBy("context")
            .agg(F.sum("score").alias("mass"), F.count("*").alias("n"), F.sum((F.col("score") > 0).cast("int")).alias("hits"))
            .where(F.col("hits") >= support).select("context", (F.col("mass") / (F.col("n") + 1)).alias("score")),
            "pii-contexts",
        )
        doubt = F.sum(F.log1p(-F.least(F.coalesce("context_score", F.lit(0.0)), F.lit(0.999999))))
        values = (
            edges.join(scored.select("context", F.col("score").alias("context_score")), "context", "left").groupBy("value")
            .agg(F.max("seed").alias("seed"), doubt.alias("doubt")).select("value", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("doubt")).alias("score"))
        )
    trusted = scored.where(F.col("score") >= confidence).select("context")
    hits = marks.where(F.col("kind") == kinds).select("text_key", "start", "end", F.explode("contexts").alias("context")).join(trusted, "context", "left_semi")
    return hits.groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct(F.lit(kinds).alias("kind"), "start", "end"))).alias("added"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, base and added spans (array of kind number, start, end; code points, end exclusive), row for row.

    Null texts count as empty and have no spans; repeated rows and null ids stay; other columns are not read.
    """
    copies = 16  # rows of one text are dealt out by their number, written beside them
    base = written(base_spans(docs, id_col, text_col).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(copies)).cast("int")), "pii-base")
    spans = F.transform(F.filter("marks", lambda m: m["kind"] < len(KINDS) - 1), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    open_ = F.exists("marks", lambda m: m["kind"] == len(KINDS) - 1)  # other rows have nothing to add, and meet no other
    salted = base.where(open_)
    added = learned_spans(base).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    met = salted.join(added, ["text_key", "salt"], "left").select("doc_id", "text_key", spans.alias("base"), F.coalesce("added", none).alias("added"))
    return met.unionByName(base.where(~open_).select("doc_id", "text_key", spans.alias("base"), none.alias("added")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns; each found span gives way to its kind in angle brackets, overlapping ones to one.

    Texts with neither a digit nor an at sign pass without a join. Null texts stay null.
    """
    suspect, copies = F.coalesce(F.col(text_col).rlike("[0-9@]"), F.lit(False)), 16
    rows = docs.where(suspect).select(F.struct("*").alias("row"), F.md5(F.col(text_col).cast("binary")).alias("text_key"), F.pmod(F.monotonically_increasing_id(), F.lit(copies)).cast("int").alias("salt"))
    found = find_pii(docs.where(suspect).select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).groupBy("text_key").agg(F.first(F.concat("base", "added")).alias("spans"))
    found = found.where(F.size("spans") > 0).withColumn("spans", F.array_sort("spans", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["kind"] - b["kind"])))
    # where the spans before each one end, and where the last one does
    found = found.withColumn("from", _scanned(F.transform("spans", lambda s: s["end"]), lambda a, x: F.greatest(a, x))).withColumn("last", F.array_max(F.transform("spans", lambda s: s["end"])))
    cuts = F.zip_with("spans", "from", lambda s, pos: F.named_struct(F.lit("kind"), s["kind"], F.lit("start"), s["start"], F.lit("pos"), pos))
    cuts = F.filter(cuts, lambda c: c["start"] >= c["pos"])
    found = found.select("text_key", "last", _blocks(cuts, "array<array<struct<kind:int,start:int,pos:int>>>", 256).alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("salt"))
    text, names = F.col("row")[text_col], F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def drawn(cuts: Column) -> Column:
        """The text from a block's first place to its last span, which is cut out once and then again for each span."""
        first = cuts[0]["pos"]
        part = F.substring(text, first + 1, F.element_at(cuts, -1)["start"] - first)
        pieces = F.transform(F.array(F.named_struct(F.lit("cuts"), cuts, F.lit("part"), part)), lambda b: F.array_join(F.transform(b["cuts"], lambda c: F.concat(F.substring(b["part"], c["pos"] - b["cuts"][0]["pos"] + 1, c["start"] - c["pos"]), F.get(names, c["kind"]))), ""))
        return F.array_join(pieces, "")

    cleaned = F.concat(F.array_join(F.transform("blocks", drawn), ""), F.substring(text, F.col("last") + 1, F.length(text)))
    changed = rows.join(found, ["text_key", "salt"], "left").select(*(F.coalesce(cleaned, text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
    return docs.where(~suspect).unionByName(changed)
