"""Personal data: base rules, and candidate gradient boosting, in column expressions.

Base spans (email, ip, card, phone) are matches of fixed patterns that pass their checks; they always
stay.  High-recall generators propose further spans, which may overlap: loose emails, dotted or
spaced quads, long digit chains, phone-like runs without a plus.  Each candidate has format and
context features; boosted trees, fitted on the small labelled table below, score it.  The margins of
held-out folds are calibrated to probabilities by a logistic fit; per kind the threshold is the lowest
probability, ``LEAST`` at least, above which the share of personal data among the held-out candidates is
``PRECISION``.  Of overlapping candidates above their threshold the best stays.

Positions of matches come from ``split`` and ``regexp_extract_all`` with one pattern: the matches and the
parts between them, whose lengths (code points) add up.  The patterns are possessive where nothing can
be given back, which keeps long runs linear; an email's local part is anchored at its run's start or
the last match's end, where the leftmost match must begin.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .exprs import clusters, cut_text, let, sums_before
from .store import with_columns_free

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+(?:@| ?[\[(] ?(?:at|AT|@) ?[\])] ?)[A-Za-z0-9-]{1,63}+"
             r"(?:(?:\.| ?[\[(] ?(?:dot|DOT|\.) ?[\])] ?)[A-Za-z0-9-]{1,63}+){0,4}+",
    "ip": r"[0-9]{1,3}+(?:[.,] ?[0-9]{1,3}+){3}+",
    "card": r"(?<![0-9])[0-9]{14,19}(?![0-9])|[0-9](?:[\x20./-]?[0-9]){11,18}+",
    "phone": r"\+ ?[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])|"
             r"(?:\+ ?|00|\()?[0-9](?:[\x20().0-9/-]){6,18}[0-9]",
}
#: Words before a span that speak for its kind, and against any.
FOR = {"email": r"(?i)\b(?:e?-?mail|contact|write|reach|address)", "ip": r"(?i)\b(?:ip\b|host|server|addr|from|login|client)",
       "card": r"(?i)\b(?:card|visa|master|amex|credit|payment|paid)",
       "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|whatsapp|ring|contact)"}
AGAINST = r"(?i)\b(?:version|v\b|isbn|order|invoice|id\b|serial|sku|date|page|chapter|section|token|key|hash|commit|release|build|total|sum|ratio)"

#: Held-out share of personal data above a kind's threshold, and its least probability.
PRECISION, LEAST = 0.98, 0.75

FEATURES = ("kind", "digits", "separators", "before", "after", "speaks_for", "speaks_against", "regular", "length", "checks")

#: Labelled candidates: text before, span, text after, kind, 1 for personal data.
LABELLED = (
    ("write to ", "jane.doe[at]example[dot]com", " today", "email", 1), ("mail: ", "bob (at) mail.example.org", ".", "email", 1),
    ("reach me at ", "k_lee [at] example [dot] net", "", "email", 1), ("contact ", "info(at)shop.example.com", ",", "email", 1),
    ("e-mail ", "anna@intranet.local", " or", "email", 1), ("my address is ", "tom[at]example.com", " ok", "email", 1),
    ("mail ", "lee [AT] example [DOT] org", "", "email", 1), ("", "sales(at)example.com", " and", "email", 1),
    ("meet ", "me@noon", " then", "email", 0), ("price ", "5@10", " each", "email", 0), ("user ", "root@localhost", ":", "email", 0),
    ("see ", "a@b", " there", "email", 0), ("@", "x@y", "@", "email", 0), ("we stay ", "in (at) home", " now", "email", 0),
    ("rate 3", "k@2", "x", "email", 0), ("foo/", "bar@3", "/", "email", 0), ("version ", "pkg@1.2", "", "email", 0),
    ("key ", "svc@build.7", "", "email", 0), ("sit ", "here (at) once", "", "email", 0), ("look ", "left(at)you", "", "email", 0),
    ("from host ", "192,168,10,24", " at", "ip", 1), ("ip ", "10. 20. 30. 40", ";", "ip", 1), ("server ", "172,16,0,9", " is", "ip", 1),
    ("client addr ", "88, 12, 200, 7", ",", "ip", 1), ("login from ", "203,0,113,5", " failed", "ip", 1),
    ("ip addr ", "198. 51. 100. 23", "", "ip", 1), ("host ", "10,1,2,3", "", "ip", 1),
    ("version ", "1.2.3.4", "00", "ip", 0), ("total ", "1,200,300,400", "", "ip", 0), ("section ", "4.10.2.12", "a", "ip", 0),
    ("scores ", "3, 14, 15, 9", ", 26", "ip", 0), ("sum ", "12,345,678,901", " eur", "ip", 0), ("we got ", "7, 8, 9, 10", " and", "ip", 0),
    ("release ", "10.0.19041.1", "x", "ip", 0), ("figures ", "400,500,600,700", "", "ip", 0), ("", "900.800.700.600", "", "ip", 0),
    ("page ", "1, 2, 3, 4", "", "ip", 0), ("a", "1.2.3.999", "b", "ip", 0), ("order ", "2,3,5,7", "", "ip", 0),
    ("card ", "4111.1111.1111.1111", " exp", "card", 1), ("paid by visa ", "4012/8888/8888/1881", ",", "card", 1),
    ("credit card: ", "5500.0000.0000.0004", "", "card", 1), ("amex ", "3782.822463.10005", " ", "card", 1),
    ("payment with ", "6011.1111.1111.1117", ".", "card", 1), ("visa ", "4222 2222 22222", "", "card", 1),
    ("mastercard ", "5105/1051/0510/5100", "", "card", 1),
    ("isbn ", "978-3-16-148410-0", "", "card", 0), ("order ", "100020003000", " sent", "card", 0), ("id ", "1234567890123456", "", "card", 0),
    ("token", "123456789012", "abc", "card", 0), ("key ", "998877665544332211", "f", "card", 0), ("invoice ", "2023-0001-4455", "", "card", 0),
    ("serial ", "000111222333444", "", "card", 0), ("hash ", "0123456789012345", "d", "card", 0), ("date ", "2023.01.02.1230", "", "card", 0),
    ("a", "5555666677778888", "b", "card", 0), ("numbers ", "1 2 3 4 5 6 7 8 9 10 11 12", "", "card", 0),
    ("total ", "123.456.789.012", " eur", "card", 0), ("", "2222333344445555", "", "card", 0), ("f", "4444333322221111", "", "card", 0),
    # Numbers side by side, which the base rule takes for one of too many digits.
    ("was ", "4539578763621486", " 4716461583322103", "card", 1), ("and 4539578763621486 ", "4716461583322103", " for", "card", 1),
    ("the ", "5425233430109903", " 12", "card", 1), ("", "6011000990139424", " 371449635398431", "card", 1),
    ("us 6011000990139424 ", "371449635398431", ".", "card", 1), ("an ", "30569309025904", " 4", "card", 1),
    ("was ", "8646308210557563", " and", "card", 0), ("of ", "4710186410006620", " 77", "card", 0), ("the 12 ", "5555666677778889", " or", "card", 0),
    ("in ", "1234567890123456", " 1", "card", 0), ("by ", "9807915762804491", " and", "card", 0), ("und ", "60417917492113", " 33", "card", 0),
    ("et ", "700555123987654", " la", "card", 0), ("les ", "4012888888881881", " 99", "card", 1), ("to ", "5105105105105100", " 1", "card", 1),
    ("ab", "4012888888881881", "c", "card", 0), ("k", "5105105105105100", "", "card", 0), ("", "6011111111111117", "x", "card", 0),
    ("z", "4539578763621486", " 1", "card", 0), ("e", "5425233430109903", " of", "card", 0),
    ("the ", "4012888888881881", "ab", "card", 0), ("", "4539578763621486", "e9", "card", 0), ("a ", "5425233430109903", "k", "card", 0),
    ("of ", "371449635398431", "cd", "card", 0),
    ("call ", "(555) 123-4567", " now", "phone", 1), ("tel ", "0049 30 1234567", ",", "phone", 1), ("phone: ", "555-123-4567", "", "phone", 1),
    ("mobile ", "0171 2345678", ".", "phone", 1), ("fax ", "030/123456-78", "", "phone", 1), ("whatsapp ", "+ 44 20 7946 0958", "", "phone", 1),
    ("de ", "+1 (826) 555-4081", " 190.137.2.4", "phone", 1), ("of ", "+1 (017) 555-7713", " 4539578763621486", "phone", 1),
    ("la ", "+1 (386) 555-3733", " 23", "phone", 1), ("in ", "+1 (412) 555-0147", " 8 9", "phone", 1),
    ("by ", "+44 207 946 0958", " 4", "phone", 1), ("", "+49 30 123 4567", " 12 34", "phone", 1), ("was ", "+1 974 555 3436", " 10.0.0.1", "phone", 1),
    ("ring ", "555.123.4567", " today", "phone", 1), ("cell ", "(212) 555 0199", "", "phone", 1), ("contact ", "020 7946 0958", "", "phone", 1),
    ("", "(416) 555-0123", " or", "phone", 1), ("my phone is ", "555 867 5309", "", "phone", 1),
    ("date ", "2023-01-15", " at", "phone", 0), ("on ", "12.05.2021", ",", "phone", 0), ("from ", "1990-2005", "", "phone", 0),
    ("order ", "4455667788", "", "phone", 0), ("id ", "00123456789", "", "phone", 0), ("sum ", "1234567.89", " eur", "phone", 0),
    ("isbn ", "3-16-148410-0", "", "phone", 0), ("a", "12345678", "b", "phone", 0), ("token ", "60417917492", "c", "phone", 0),
    ("", "3.14159265", "", "phone", 0), ("version ", "2.10.33.4567", "", "phone", 0), ("pages ", "100 200 300", "", "phone", 0),
    ("f", "834779584", "e", "phone", 0), ("ratio ", "0.123456789", "", "phone", 0), ("in ", "2019/2020/2021", "", "phone", 0),
    ("was ", "8646308210557563", " and", "phone", 0), ("", "4710186410006621", " of", "phone", 0), ("in ", "700555123", " the", "phone", 0),
    ("the ", "30569309025904", " is", "phone", 0), ("by ", "5555 6666 7777 8888", " or", "phone", 0), ("at ", "1234567890", ",", "phone", 0),
    ("x", "555-123-4567", "y", "phone", 0), ("=", "064191774", "e", "phone", 0), ("ip ", "10.20.30.40", "", "phone", 0),
)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, span, before, after>> of the pattern's matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(v: Column) -> Column:
        steps = F.transform(v["m"], lambda m, i: (F.length(F.get(v["p"], i)) + F.length(m)).cast("long"))
        return let(sums_before(steps), lambda sums: F.transform(v["m"], lambda m, i: let(
            F.get(sums, i) + F.length(F.get(v["p"], i)), lambda start: F.struct(
                start.alias("start"), (start + F.length(m)).alias("end"), m.alias("span"),
                F.right(F.get(v["p"], i), F.lit(24)).alias("before"), F.left(F.get(v["p"], i + 1), F.lit(12)).alias("after")))))

    return let(F.struct(found.alias("m"), F.split(text, pattern, -1).alias("p")), placed)


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def total(d: Column) -> Column:
        value = F.transform(F.split(F.reverse(d), ""), lambda c, i: let(c.cast("int"), lambda x: F.when(
            i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)))
        return F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))

    return let(digits, total) % 10 == 0


def _small_parts(span: Column, pattern: str) -> Column:
    return F.forall(F.split(span, pattern), lambda x: let(F.regexp_replace(x, "^0+", ""), lambda y: F.when(
        F.length(y) <= 3, F.concat(F.lit("0"), y).cast("int") <= 255).otherwise(False)))


def _passes(kind: str, m: Column) -> Column:
    digits = F.length(_digits(m["span"]))
    if kind == "ip":
        return _small_parts(m["span"], r"\.")
    if kind == "card":
        return F.when(F.length(m["span"]) <= 40, F.when(digits.between(14, 19), luhn(_digits(m["span"]))).otherwise(False)).otherwise(False)
    if kind == "phone":
        return digits.between(10, 15)
    return F.lit(True)


def _passing(kind: str):
    return lambda m: _passes(kind, m)


def _named(k: int):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"))


def _scored(k: int, trees: list):
    return lambda m: F.struct(boosting.as_column(trees, _features(KINDS[k], m)).alias("score"), m["start"].alias("start"),
                              F.lit(k).alias("kind"), m["end"].alias("end"))


def _above(limit: float):
    return lambda c: c["score"] >= limit


def _features(kind: str, m: Column) -> list[Column]:
    span, before, after = m["span"], m["before"], m["after"]
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    edge = lambda c: F.when(c.rlike("^[A-Za-z0-9]"), 2.0).when(c.rlike(r"^[=/_@#:\"'-]"), 1.0).otherwise(0.0)
    regular = {"email": flag(span.rlike(r"(?i)(?:\.|dot[\])]) ?[A-Za-z]{2,10}$")), "ip": flag(span.rlike(r"^[0-9]+(?:([., ]+)[0-9]+)(?:\1[0-9]+){2}$")),
               "card": flag(span.rlike(r"^[0-9]{4}([\x20./-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}$|^[0-9]{4}([\x20./-])[0-9]{6}\2[0-9]{5}$|^[0-9]{14,16}$")),
               "phone": flag(span.rlike(r"^\(?[0-9]{3}\)?[\x20.-]?[\x20]?[0-9]{3}[\x20.-][0-9]{4}$|^(?:\+ ?|00)[0-9]{1,3}[\x20]"))}[kind]
    checks = {"email": flag(span.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z]|[\])]")), "ip": flag(_small_parts(span, r"[., ]+")),
              "card": flag(luhn(_digits(span))), "phone": flag(F.length(_digits(span)).between(10, 13))}[kind]
    return [F.lit(float(KINDS.index(kind))), F.length(_digits(span)).cast("double"),
            F.length(F.regexp_replace(span, "[A-Za-z0-9]", "")).cast("double"), edge(F.reverse(before)), edge(after),
            flag(before.rlike(FOR[kind])), flag(before.rlike(AGAINST)), regular, F.length(span).cast("double"), checks]


@lru_cache(maxsize=1)
def _fitted(rows: tuple[tuple[float, ...], ...]) -> tuple[list, dict[str, float]]:
    x, y = np.array([r[:-1] for r in rows]), np.array([r[-1] for r in rows])
    folds = np.arange(len(y)) % 5
    out = np.empty(len(y))
    for f in range(5):
        out[folds == f] = boosting.margins(boosting.boost(x[folds != f], y[folds != f]), x[folds == f])
    slope, shift = calibrated(out, y)
    limits = {}
    for i, kind in enumerate(KINDS):
        own = x[:, 0] == i
        p, found = 1 / (1 + np.exp(-(slope * out[own] + shift))), y[own]
        good = [t for t in np.unique(p[p >= LEAST]) if found[p >= t].mean() >= PRECISION]
        t = min(good, default=1 - 1e-6)
        # Between the threshold's candidate and the next one below it.
        below = max([q for q in p if q < t], default=0.0)
        t = max(LEAST, (t + below) / 2)
        limits[kind] = float((np.log(t / (1 - t)) - shift) / slope)
    return boosting.boost(x, y), limits


def calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to probabilities, with smoothed targets (Newton's steps)."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w, x = np.array([1.0, 0.0]), np.column_stack([margins, np.ones(len(y))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(spark: SparkSession) -> tuple[list, dict[str, float]]:
    """Trees and each kind's threshold, from the labelled table."""
    rows = []
    for kind in KINDS:
        own = [r for r in LABELLED if r[3] == kind]
        table = spark.range(1).select(F.explode(F.array(*[F.struct(
            F.lit(b).alias("before"), F.lit(s).alias("span"), F.lit(a).alias("after"), F.lit(float(y)).alias("y"))
            for b, s, a, _, y in own])).alias("m"))
        rows += [tuple(r) for r in table.select(
            *[c.alias(n) for c, n in zip(_features(kind, F.col("m")), FEATURES)], "m.y").collect()]
    return _fitted(tuple(rows))


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _kept(cluster: Column) -> Column:
    """Of a cluster the base spans (without a score), and those proposals that meet no base span and no better proposal
    that meets none."""
    better = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (
        (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"]))))

    def chosen(cl: Column) -> Column:
        base = F.filter(cl, lambda c: c["score"].isNull())
        return let(base, lambda bs: let(
            F.filter(cl, lambda c: c["score"].isNotNull() & ~F.exists(bs, lambda b: _meets(b, c))), lambda new: F.concat(
                bs, F.filter(new, lambda c: ~F.exists(new, lambda o: _meets(o, c) & better(o, c))))))

    return F.when(F.size(cluster) == 1, cluster).otherwise(let(cluster, chosen))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns base and spans added: array<struct<start, kind, end>> (kind 0-3 in the
    order of ``KINDS``) by start, then kind.  Without shuffle.

    A null or empty text has no spans.  Null ids and repeated rows are as any; an empty table gives no
    rows.  Input columns named base or spans are replaced."""
    trees, limits = fit(docs.sparkSession)
    p = with_columns_free(docs, "t", *KINDS, "new", "base", "kept")
    span = "array<struct<start:bigint,kind:int,end:bigint>>"
    none = F.array().cast(span)
    out = docs.withColumn(p + "t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    text = F.col(p + "t")
    out = out.withColumn(p + "digit", text.rlike("[0-9]"))
    may = {"email": F.instr(text, "@") > 0, "ip": F.col(p + "digit"), "card": F.col(p + "digit"),
           "phone": F.col(p + "digit") & (F.instr(text, "+") > 0)}
    for k, kind in enumerate(KINDS):
        found = F.transform(F.filter(matches(text, BASE[kind]), _passing(kind)), _named(k))
        out = out.withColumn(p + kind, F.when(may[kind], found.cast(span)).otherwise(none))
    out = out.withColumn(p + "base", F.array_sort(F.concat(*[F.col(p + kind) for kind in KINDS])))
    may["email"] = may["email"] | text.rlike(r"(?:\(|\[) ?(?:at|AT)")
    may["phone"] = F.col(p + "digit")
    scored_span = "array<struct<score:double,start:bigint,kind:int,end:bigint>>"
    for k, kind in enumerate(KINDS):
        chosen = F.filter(F.transform(matches(text, GENERATORS[kind]), _scored(k, trees)), _above(limits[kind]))
        out = out.withColumn(p + kind, F.when(may[kind], chosen.cast(scored_span)).otherwise(F.array().cast(scored_span)))
    # Base spans and proposals in order, cut into clusters that don't meet each other: only within one are they compared.
    both = F.array_sort(F.concat(
        F.transform(F.col(p + "base"), lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"),
                                                          F.lit(None).cast("double").alias("score"))),
        *[F.transform(F.col(p + kind), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"),
                                                          c["score"].alias("score"))) for kind in KINDS]))
    kept = F.flatten(F.transform(clusters(both), _kept))
    out = out.withColumn("base", F.col(p + "base")).withColumn("spans", F.when(
        reduce(lambda a, b: a | b, [F.size(p + kind) > 0 for kind in KINDS]), F.array_sort(F.transform(kept, lambda c: F.struct(
            c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))).otherwise(F.col(p + "base")))
    return out.select(*[c for c in docs.columns if c not in ("base", "spans")], "base", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (n_chars follows); overlapping spans are
    replaced together, by the first one's kind.  Texts without spans, and null ones, stay as they are."""
    p = with_columns_free(docs, "spans", "text", "cuts")
    held = [c for c in ("base", "spans") if c in docs.columns]
    kept = docs.select("*", *[F.col(c).alias(f"{p}own_{c}") for c in held]).drop(*held)
    found = find_pii(kept).withColumnRenamed("spans", p + "spans").drop("base")
    # Cuts: the spans, with overlapping ones joined.
    joined = F.transform(clusters(F.col(p + "spans")), lambda cl: F.struct(
        F.get(cl, F.lit(0))["start"].alias("start"), F.get(cl, F.lit(0))["kind"].alias("kind"),
        F.array_max(F.transform(cl, lambda s: s["end"])).alias("end")))
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found = found.withColumn(p + "cuts", F.when(F.size(p + "spans") > 0, joined))
    cuts = F.col(p + "cuts")
    found = found.withColumn("text", F.when(cuts.isNotNull(), cut_text(
        F.col("text"), cuts, lambda s: F.get(name, s["kind"]))).otherwise(F.col("text")))
    found = found.withColumn("n_chars", F.when(cuts.isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(
        docs.schema["n_chars"].dataType))
    return found.select(*[F.col(f"{p}own_{c}").alias(c) if c in held else c for c in docs.columns])
