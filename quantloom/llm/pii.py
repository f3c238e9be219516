"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. Native operations only.

For each kind a regular expression splits a text into what stands between the matches and the matches themselves;
zipped together these are walked row by row, and running sums of their lengths in code points give every start and
end. The patterns are the plain ones of the kinds, written so that Java's matcher neither backtracks nor recurses
over long runs (possessive repeats; an email may only start where its run of characters starts or a match has just
ended), which leaves the matches as they are.

Kinds: email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone (9 to 15 digits) and, added by the method,
iban (as long as its country's are, mod-97), ssn (three groups of digits, none of them void) and secret (32 or more
hexadecimal digits with both letters and figures). A match that fails its check is dropped. A span's score is that of
its kind, plus ``CONTEXT_BONUS`` if a word of the kind stands within ``CONTEXT`` characters; spans of added kinds below
``LEAST_SCORE`` are dropped, those of the four base kinds always stay. So an iban, which mod-97 confirms, needs no
context, and the words beside it decide whether a number is an ssn or a string of digits a secret.

Cases: a null or empty text has no spans; spans of different kinds may overlap and all are listed; equal starts are
listed in the order of kinds; repeated rows are each searched; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import DIGEST, bounded, digest, documents, quoted, store

CONTEXT = 40
CONTEXT_BONUS = 0.25
LEAST_SCORE = 0.8

_LOCAL = "[A-Za-z0-9._%+-]"
#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN_IBAN = "(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
#: Of other countries the length is not known; such a match ends before an IBAN of a known one.
_OTHER_IBAN = rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{_KNOWN_IBAN}))?[A-Z0-9]){{11,30}}(?![A-Za-z0-9])"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_KNOWN_IBAN}|{_OTHER_IBAN})",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "secret": r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
#: A cheap test that every text with a match passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}", "secret": "[0-9A-Fa-f]{32}"}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.85, "ssn": 0.6, "secret": 0.6}
CONTEXT_WORDS = {
    "email": "(?i)mail|contact|address",
    "ip": "(?i)\\bip\\b|host|server|address|login",
    "card": "(?i)card|credit|visa|pay|debit",
    "phone": "(?i)phone|call|tel|mobile|fax",
    "iban": "(?i)iban|account|bank|transfer",
    "ssn": "(?i)\\bssn\\b|social|security|taxpayer",
    "secret": "(?i)token|secret|\\bkey|api_?key|passw|credential|bearer",
}


def confirmed(kind: Column, match: Column) -> Column:
    """Whether a match passes the check of its kind."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    part = F.forall(F.split(match, "[.]"), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")).between(1, 3) & (F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255))
    bare = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return (
        F.when(kind == "ip", F.coalesce(part, F.lit(False)))
        .when(kind == "card", n.between(12, 19) & F.call_function("luhn_check", digits))
        .when(kind == "phone", n.between(9, 15))
        .when(kind == "iban", F.length(bare).between(15, 34) & (rest == 1))
        .when(kind == "ssn", ~match.rlike("^(?:000|666|9)|-00-|0000$"))
        .when(kind == "secret", match.rlike("[0-9]") & match.rlike("[A-Fa-f]"))
        .otherwise(F.lit(True))
    )


def by_kind(values: dict[str, object], kind: Column) -> Column:
    return reduce(lambda c, kv: c.when(kind == kv[0], F.lit(kv[1])), list(values.items())[1:], F.when(kind == next(iter(values)), F.lit(next(iter(values.values())))))


def spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(rid, keep..., spans): a row for every row of ``docs``, spans as array<struct<start, ord, end, kind, score>>, sorted."""
    taken = [F.col(c).alias(f"_{k}") for k, c in enumerate(keep)]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), *taken, F.coalesce(F.col(text), F.lit("")).alias("t"))
    zips = [
        F.struct(F.lit(k).alias("kind"), F.when(F.col("t").rlike(HINTS[k]), F.arrays_zip(F.split("t", p, -1).alias("gap"), F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias("m"))).alias("z"))
        for k, p in PATTERNS.items()
    ]
    own = [f"_{k}" for k in range(len(keep))]
    each = rows.select("rid", *own, F.explode(F.array(*zips)).alias("k"))
    # a text without a match of a kind has one gap and no match: its row is kept once, for the first kind
    walked = each.where("k.kind = 'email' OR size(k.z) > 1").select("rid", *own, F.col("k.kind").alias("kind"), F.posexplode_outer("k.z").alias("i", "z"))
    part = walked.select(
        "rid",
        *own,
        "kind",
        "i",
        F.coalesce(F.length("z.gap"), F.lit(0)).alias("gap"),
        F.right(F.coalesce("z.gap", F.lit("")), F.lit(CONTEXT)).alias("before"),
        F.left(F.coalesce("z.gap", F.lit("")), F.lit(CONTEXT)).alias("head"),
        F.col("z.m").alias("m"),
    )
    # every later step needs the rows of a document together, and this is the only shuffle
    part = part.repartition("rid")
    order = Window.partitionBy("rid", "kind").orderBy("i")
    length = F.coalesce(F.length("m"), F.lit(0))
    placed = part.withColumn("end", F.sum(F.col("gap") + length).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.lead("head").over(order))
    kind = F.col("kind")
    near = F.concat_ws(" ", "before", F.coalesce("after", F.lit("")))
    score = by_kind(SCORES, kind) + F.when(reduce(lambda a, k: a | ((kind == k) & near.rlike(CONTEXT_WORDS[k])), PATTERNS, F.lit(False)), CONTEXT_BONUS).otherwise(0.0)
    scored = placed.withColumn("score", F.round(F.least(score, F.lit(1.0)), 2))
    good = F.col("m").isNotNull() & confirmed(kind, F.col("m")) & (kind.isin(*BASE) | (F.col("score") >= LEAST_SCORE))
    ordinal = by_kind({k: i for i, k in enumerate(PATTERNS)}, kind)
    span = F.when(good, F.struct((F.col("end") - length).cast("long").alias("start"), ordinal.alias("ord"), F.col("end").cast("long").alias("end"), kind.alias("kind"), "score"))
    return scored.groupBy("rid").agg(*[F.first(o).alias(o) for o in own], F.array_sort(F.collect_list(span)).alias("spans")).select("rid", *[F.col(o).alias(c) for o, c in zip(own, keep, strict=True)], "spans")


def joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans by kind, base_sha256, spans and scores of every row of ``docs``."""
    found = spans(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [of(k) for k in PATTERNS]
    scores = F.concat_ws(",", F.transform("spans", lambda s: s["score"].cast("string")))
    return found.select("doc_id", *count, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir, "doc_id", "text"))


def redacted(text: Column, found: Column) -> Column:
    """The text with every run of spans replaced by the name of its first kind in brackets."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        cut = F.concat(F.substr(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(cut))).alias("out"))

    return F.aggregate(found, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, (a["at"] + 1).cast("int"))))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced by the name of its kind, and n_chars follows.

    Spans belong to texts, so all rows of a text are redacted alike, whatever their ids; a null text stays null; an empty
    table stays empty.
    """
    columns, kinds = docs.columns, docs.schema
    docs = docs.withColumn(DIGEST, digest())
    hit = spans(docs, keep=(DIGEST,)).where(F.size("spans") > 0).dropDuplicates([DIGEST])
    met = docs.join(bounded(store(hit.select(DIGEST, F.col("spans").alias("__pii_spans")), "pii")), DIGEST, "left")
    whole = F.col("__pii_spans").isNull()
    out = met.withColumn("__pii_text", F.when(whole, F.col("text")).otherwise(redacted(F.col("text"), F.col("__pii_spans"))))
    changed = {"text": F.col("__pii_text")}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length("__pii_text")).cast(kinds["n_chars"].dataType)
    return out.select(*[changed[c].alias(c) if c in changed else F.col(quoted(c)) for c in columns])
