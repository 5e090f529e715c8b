"""Personal data: fixed forms first, then contextual extraction by bootstrapping.

DataFrame and SQL functions only.

1. Base spans: e-mail and IP addresses, card and phone numbers by pattern and validity.
2. Seeds are the values of base spans and, for kind ``secret``, tokens with a published key prefix
   or assigned to a credential's name. A lexical pattern is the two words to the left or to the
   right with the form of the identifier between; for long hex and key-like forms also the form
   alone or with its first four characters. Tokens that look like identifiers and are no base span
   are candidates. Patterns and the different values they hold make a bipartite graph.
3. Scores are passed to and fro. A pattern's trust in a kind is the summed score of its values of
   that kind over all its values (with a prior towards nothing); only patterns that hold
   ``least_seeds`` sure values of the kind count. A candidate's score is the chance that any of its
   patterns is right; at ``confidence`` its value is sure and seeds patterns of the next round.
   Seeds stay at 1; number tokens that were tested and failed as a card stay at 0.
4. Candidates of sure value that stand in a pattern of ``confidence`` get its kind.

Seeds of kind ``secret`` may be taken from a share of the documents (``seeded``). In the others such
tokens are candidates like any other, so what patterns find there is found without its form; the
form's own spans are added in all documents.

All steps after the scan work on the few identifier-like tokens; the text is read once and not
moved. Positions count code points, ends are exclusive.

Defined results: a null text is empty and has no spans; rows that repeat an id are told apart by
their text; rows that repeat both have the same spans; a pattern or value with equal trust in two
kinds takes the one that is later in the alphabet; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans, in the order of ``spans``.
ALL_KINDS = (*KINDS, "secret")
#: The leftmost matches of the base patterns. Possessive repeats and look-behinds only keep a
#: search linear: they forbid starts inside a run whose own start has failed already.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "phone": "+"}
_BLANK, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Words with a digit or an at sign, and long words of capitals.
TOKEN = rf"(?<!{_WORD})(?:[^\x20\x09-\x0D0-9@]*+[0-9@]{_WORD}*+|[A-Z]{{16,}}+)"
EDGES = r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$"
#: Published prefixes of access keys.
KEY_SEED = "^(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|[sr]k_live_[0-9A-Za-z]{16,})$"
#: Left contexts that give a value to a credential's name.
NAME_SEED = "(?:^|[^a-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|secret[_-]?key) ?[=:]$"
_SPAN = "array<struct<start:bigint,stop:bigint,value:string,left:string,right:string>>"
_ADDED = "array<struct<kind:string,start:bigint,stop:bigint>>"


def _once(x: Column, f) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _starts(z: Column) -> Column:
    """Places of the matches, from the lengths of what lies between them."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(
        F.arrays_zip(z["p"].alias("p"), z["m"].alias("m")),
        F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("starts")),
        lambda a, x: F.when(x["m"].isNull(), a).otherwise(F.struct((a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"), F.array_append(a["starts"], a["at"] + F.length(x["p"])).alias("starts"))),
        lambda a: a["starts"],
    )


def located(text: Column, pattern: str) -> Column:
    """All matches with their places and the two words on each side, other matches included."""
    words = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), f"{_BLANK}+", " "), "[0-9]+", "0")

    def one(z: Column) -> Column:
        before = F.concat(F.lit("^ ^ "), F.right(z["pl"], F.lit(48)), F.right(z["ml"], F.lit(48)), z["l"])
        after = F.concat(F.left(z["r"], F.lit(96)), F.left(z["mr"], F.lit(48)), F.left(z["pr"], F.lit(48)), F.lit(" ^ ^"))
        return F.struct(
            z["s"].alias("start"),
            (z["s"] + F.length(z["m"])).alias("stop"),
            z["m"].alias("value"),
            words(F.regexp_extract(F.right(before, F.lit(96)), rf"({_WORD}+{_BLANK}+{_WORD}+){_BLANK}*$", 1)).alias("left"),
            words(F.regexp_extract(after, rf"^{_BLANK}*({_WORD}+{_BLANK}+{_WORD}+)", 1)).alias("right"),
        )

    def every(z: Column) -> Column:
        later = lambda x, k: F.slice(x, F.lit(k + 1), F.size(x))
        first = F.array(F.lit(""))
        zipped = F.arrays_zip(
            _starts(z).alias("s"), z["m"].alias("m"), z["p"].alias("l"), F.concat(first, z["p"]).alias("pl"), F.concat(first, z["m"]).alias("ml"),
            later(z["p"], 1).alias("r"), F.concat(later(z["m"], 1), first).alias("mr"), F.concat(later(z["p"], 2), first).alias("pr"),
        )
        return F.when(F.size(z["m"]) > 0, F.transform(F.filter(zipped, lambda x: x["m"].isNotNull() & x["s"].isNotNull()), one)).otherwise(F.array().cast(_SPAN)).cast(_SPAN)

    return _once(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), every)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    each = F.transform(F.split(F.reverse(digits(value)), ""), lambda c, i: c.try_cast("int") * (i % 2 + 1))
    total = F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.coalesce(F.regexp_replace(x, "^0+(?=.)", "").try_cast("decimal(38,0)") <= 255, F.lit(False)))
    n = F.length(digits(value))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(value)).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    hint = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
    return F.when(hint, F.filter(located(text, PATTERNS[kind]), lambda x: valid(kind, x["value"]))).otherwise(F.array().cast(_SPAN))


def form(value: Column) -> Column:
    """Form of an identifier: what it is made of, and for long keys how long it is."""
    long_key = F.length(value) >= 16
    return (
        F.when(F.contains(value, F.lit("@")), "mail")
        .when(value.rlike(r"^[0-9 ().+-]+$"), "number")
        .when(long_key & value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.concat(F.lit("hex"), F.length(value).cast("string")))
        .when(long_key & value.rlike("^[A-Z0-9]*[0-9][A-Z0-9]*$"), F.concat(F.lit("key"), F.length(value).cast("string")))
        .otherwise("mixed")
    )


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, raw, base spans by kind, and candidate tokens. One pass, no shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("raw"), text.alias("t"))
    out = rows.select("doc_id", "raw", *(base_spans(F.col("t"), kind).alias(kind) for kind in KINDS), F.when(F.col("t").rlike("[0-9@]|[A-Z]{16}"), located(F.col("t"), TOKEN)).otherwise(F.array().cast(_SPAN)).alias("tokens"))
    return out


def _patterns(x: Column) -> Column:
    """The patterns that hold a found value: (side, word, form)."""
    kind = form(x["value"])
    place = lambda side, word: F.struct(F.lit(side).alias("side"), word.alias("word"), kind.alias("form"))
    every = F.array(place("l", x["left"]), place("r", x["right"]), place("f", F.lit("-")), place("i", F.lower(F.left(x["value"], F.lit(4)))))
    return F.filter(every, lambda y: (y["word"] != "") & (y["side"].isin("l", "r") | y["form"].rlike("^(hex|key)")))


def _named(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))


def _of_kind(kind: str) -> Column:
    return F.filter("added", lambda x: x["kind"] == kind)


def _places(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))


def extract(docs: DataFrame, least_seeds: int = 3, confidence: float = 0.8, prior: float = 1.0, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text", seeded: float = 1.0) -> DataFrame:
    """One row per document: doc_id, counts of base spans, base_sha256, spans, n_added, n_induced, n_spans.

    ``n_added`` counts spans that are no base spans, ``n_induced`` those of them that patterns found
    and no seed of their document. ``seeded``: share of texts, by hash, whose secrets are seeds.
    """
    rows = written(scanned(docs, id_col, text_col), "pii-rows")
    key = ["side", "word", "form"]
    named = F.concat(*(_named(kind) for kind in KINDS))
    seeds = rows.select(F.explode(named).alias("s")).select(F.col("s.kind").alias("kind"), F.col("s.x").alias("x"))
    # candidates: tokens without the marks around them, outside base spans
    token = F.col("x")
    lead = F.length(F.regexp_extract(token["value"], r"^([^A-Za-z0-9+]*)", 1))
    core = F.regexp_replace(token["value"], EDGES, "")
    clear = F.filter("tokens", lambda x: ~F.exists(F.concat(*KINDS), lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"])))
    free = rows.select("doc_id", "raw", F.explode(clear).alias("x"))
    free = free.select("doc_id", "raw", F.struct((token["start"] + lead).alias("start"), (token["start"] + lead + F.length(core)).alias("stop"), core.alias("value"), token["left"].alias("left"), token["right"].alias("right")).alias("x"))
    free = free.where((F.length("x.value") >= 6) & F.col("x.value").rlike("[0-9@]|^[A-Z]{16,}$"))
    value = F.col("x.value")
    secret = value.rlike(KEY_SEED) | (F.col("x.left").rlike(NAME_SEED) & (F.length(value) >= 16) & value.rlike("[0-9]"))
    failed = F.length(digits(value)).between(16, 19) & (form(value) == "number")
    known = secret & ~failed
    sown = known & (F.pmod(F.xxhash64(F.lit(4), "raw"), F.lit(1_000_000)) < int(seeded * 1_000_000))
    free = free.withColumns({"kind": F.when(known, "secret"), "seed": F.when(sown, "secret"), "failed": failed})
    free = written(free, "pii-free")

    both = seeds.select("kind", "x", F.lit(False).alias("failed")).union(free.select(F.col("seed").alias("kind"), "x", "failed"))
    edges = written(both.select(value.alias("value"), F.explode(_patterns(F.col("x"))).alias("e")).select("value", "e.*").distinct(), "pii-edges")
    fixed = F.when(F.col("kind").isNotNull(), 1.0).when(F.col("failed"), 0.0)
    known = written(both.groupBy(value.alias("value")).agg(F.max("kind").alias("kind"), F.max(fixed).alias("fixed")), "pii-values")
    scores = known.withColumn("score", F.coalesce("fixed", F.lit(0.0)))
    sure = None
    for _ in range(rounds):
        # growing tables meet by merging: neither is ever sent whole to every executor
        held = edges.join(scores.hint("merge"), "value")
        trust = held.groupBy(*key, "kind").agg(F.sum("score").alias("hits"), F.count_if(F.col("score") >= confidence).alias("n"), F.count("*").alias("of"))
        trust = trust.groupBy(*key).agg(F.max(F.struct("hits", "kind", "n")).alias("x"), F.sum("of").alias("of"))
        trust = trust.where(F.col("x.kind").isNotNull() & (F.col("x.n") >= least_seeds)).select(*key, F.col("x.kind").alias("gives"), (F.col("x.hits") / (F.col("of") + prior)).alias("trust"))
        trust = written(trust, "pii-trust")
        offers = edges.join(trust.hint("merge"), key).groupBy("value", "gives").agg(F.max("trust").alias("best"), F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("trust")))).alias("doubt"))
        offers = offers.groupBy("value").agg(F.max(F.struct("best", "gives", (1 - F.exp("doubt")).alias("score"))).alias("o"))
        scores = known.join(offers.hint("merge"), "value", "left").select("value", F.coalesce("kind", "o.gives").alias("kind"), "fixed", F.coalesce("fixed", "o.score", F.lit(0.0)).alias("score"))
        scores = written(scores, "pii-scores")
        last, sure = sure, tuple(scores.where((F.col("score") >= confidence) & F.col("fixed").isNull()).agg(F.count("*"), F.sum(F.xxhash64("value", "kind").cast("decimal(20,0)"))).first())
        if sure == last:
            break
    place = ["doc_id", "raw", F.col("x.start").alias("start"), F.col("x.stop").alias("stop")]
    place_names = ["doc_id", "raw", "start", "stop"]
    own = free.where("kind is not null").select(*place, "kind", F.lit(0).alias("induced"))
    open_ = free.where("seed is null and not failed").select(*place, value.alias("value"), F.explode(_patterns(F.col("x"))).alias("e")).select("*", "e.*").drop("e")
    found = open_.join(trust.where(F.col("trust") >= confidence).hint("merge"), key)
    found = found.join(scores.where(F.col("fixed").isNull() & (F.col("score") >= confidence)).select("value").hint("merge"), "value", "left_semi")
    found = found.groupBy("doc_id", "raw", "start", "stop").agg(F.max_by("gives", F.struct("trust", "gives")).alias("kind")).withColumn("induced", F.lit(1))
    # a text's own spans only: bounded by its length
    found = own.union(found).groupBy(*place_names, "kind").agg(F.max("induced").alias("induced"))
    found = found.groupBy(F.col("doc_id").alias("__id"), F.col("raw").alias("__raw")).agg(F.sort_array(F.collect_list(F.struct("kind", "start", "stop"))).alias("added"), F.sum("induced").alias("n_induced"))
    out = rows.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("raw") == F.col("__raw")), "left").withColumn("added", F.coalesce("added", F.array().cast(_ADDED)))
    said = lambda kind, xs: F.transform(xs, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["stop"].cast("string")))
    base = {kind: _places(F.col(kind)) for kind in KINDS}
    every = {kind: F.array_sort(F.concat(base[kind], _places(_of_kind(kind))) if kind in base else _places(_of_kind(kind))) for kind in ALL_KINDS}
    n_base = sum((F.size(kind) for kind in KINDS), F.lit(0))
    return out.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(F.array_join(F.concat(*(said(k, base[k]) for k in KINDS)), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*(said(k, every[k]) for k in ALL_KINDS)), ",").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.coalesce("n_induced", F.lit(0)).cast("long").alias("n_induced"),
        (n_base + F.size("added")).cast("long").alias("n_spans"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the texts give seeds, so ``n_induced`` tells what patterns find in the other half."""
    return extract(table(spark, sf_dir, "documents"), seeded=0.5)
