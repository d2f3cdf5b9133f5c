"""Personal data by weak supervision: operator 13, with DataFrame functions only.

Four patterns with checks give base spans: e-mail and IP addresses, card and phone numbers. The method adds spans of
further kinds that a pattern alone can't tell from harmless text: spelled-out addresses, phone numbers without a country,
social security numbers, IBANs, names after a title and dates of birth. Labelers vote on every candidate, the base ones
among them: by strict form, by checksums and ranges, by gazetteers, by words before it that speak of persons or of other
things, by units after it. Votes are +1, -1 or, with nothing to say, 0. Expectation maximisation estimates, kind by
kind, how reliable each labeler is and how likely each candidate is personal, from the counts of the patterns of votes
over the whole table.
From these likelihoods a logistic classifier of spans is trained, on kind, shape and what the labelers saw; candidates
of the further kinds that it scores LEAST_SCORE or more are added unless they touch a base span.

The texts are read once; candidates are kept in a table, and both fits run over the few distinct patterns, one row.
Patterns are written so that none goes back over a long run: the same matches as the plain forms beside them.

Defined results: a null or empty text has no span; texts of any length are searched whole; repeated rows and rows
without doc_id are searched one by one; offsets are code points with the end exclusive. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm.common import table, written

# Plain forms: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), [0-9]([\x20-]?[0-9])+
# (of those, chains of 16 to 19 digits) and \+[0-9][\x20().0-9-]+[0-9]. A match may begin where the last one ended (\G).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
_START, _END = r"(?<![\p{L}\p{N}_.+/-])", r"(?![\p{L}\p{N}_])(?![.,/-][0-9])"
FURTHER = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{2,63}){1,4}|\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{2,63}){1,4}|＠[A-Za-z0-9-]{1,63}(?:[.．][A-Za-z0-9-]{2,63}){1,4})(?![A-Za-z0-9-])",
    "iban": _START + r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?" + _END,
    "ssn": _START + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "call": _START + r"(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20.-]?[0-9]{3,5}" + _END,
    "born": _START + r"(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})" + _END,
    "name": r"(?<![\p{L}\p{N}])(?:Mrs?|Ms|Mx|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?)(?:\.\x20|\x20|\.)\p{Lu}\p{L}{1,30}(?:[\x20-]\p{Lu}\p{L}{1,30}){0,2}",
}
#: Any of them. All begin where no letter or digit of ASCII stands before, which is asked first.
_ANY = r"(?<![A-Za-z0-9])(?=[A-Za-z0-9(._%+-])(?:" + "|".join(FURTHER.values()) + ")"
KINDS = (*BASE, *FURTHER)
#: Code points of context that labelers see on either side.
CONTEXT = 60
LABELERS = ("form", "check", "gazetteer", "personal", "other", "unit")
#: From this score of the classifier on, a candidate is added.
LEAST_SCORE = 0.7
EM_STEPS, FIT_STEPS = 30, 300
#: What is believed before anything is seen: how often a labeler casts each vote on what is personal and on what isn't,
#: worth so many votes; so many candidates of each kind that are personal and that aren't; weights of the classifier near 0.
PRIOR_YES, PRIOR_NO, PRIOR_VOTES = {-1: 0.03, 0: 0.37, 1: 0.6}, {-1: 0.3, 0: 0.5, 1: 0.2}, 20.0
PRIOR_KIND, MOST_KIND, SHRINK = 5.0, 3.0, 1.0
#: The most that a vote of -1 leaves of a candidate's odds, by labeler (a checksum that fails leaves next to nothing); the
#: least that +1 makes of them, and that a vote of 0 leaves.
MOST_DOUBT, LEAST_FAITH, LEAST_NOTHING = (0.5, 0.001, 0.02, 0.5, 0.1, 0.1), 2.0, 0.5

TLDS = "com org net edu gov mil int io dev app info biz eu de fr es uk it nl be ch at us ca au jp cn in br mx ru pl se no fi dk ie pt gr cz".split()
COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split()
GIVEN = "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Anna Maria Peter Paul Hans Klaus Ursula Monika Sabine Stefan Andreas Pierre Jean Marie Sophie Claire Luc Jacques Carlos Juan José Carmen Lucia Pablo Antonio Isabel".split()
CODES = "1|7|2[07]|3[0-4]|36|39|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-3]|5[09][0-9]|6[789][0-9]|85[0-6]|88[06]|9[679][0-9]"
PERSONAL = {
    "email": "e-?mail|mail|contact|write|reach|address|kontakt|correo|courriel|schreib", "mail": "e-?mail|mail|contact|write|reach|address|kontakt|correo|courriel|schreib",
    "ip": r"\bip\b|address|host|login|logged|visitor|client|user", "card": "card|credit|debit|visa|mastercard|amex|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|cell|fax|contact|ring|telefon|handy|llam|appel", "call": "phone|tel|call|mobile|cell|fax|contact|ring|telefon|handy|llam|appel",
    "ssn": r"ssn|social|security", "iban": "iban|account|bank|konto|cuenta|compte|transfer", "born": r"born|birth|dob|geboren|geburt|nacid|nacim|né[e]? le|naissance",
    "name": "name|dear|signed|patient|contact|sincerely|regards|attn|liebe|sehr geehrte|querid|cher",
}
OTHER = r"isbn|issn|doi|version|release|\bv\.|figure|fig\.|table|order|invoice|part no|serial|sku|page|chapter|article|published|updated|since|copyright|build|section|port|lot"
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
FORMS = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+\.)++[A-Za-z]{2,}$", "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$", "card": r"^[0-9]{16}$|^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4,7}$",
    "phone": r"^\+[1-9][0-9]{0,2}(?:[\x20.-]?\([0-9]{1,4}\))?(?:[\x20.-]?[0-9]{2,}+)++$", "mail": r"[\[({]\x20?at\x20?[\])}].*dot|\x20at\x20.*\x20dot\x20[a-z]{2,}$|＠", "iban": r"^[A-Z]{2}[0-9]{2}\x20?[A-Z0-9\x20]{11,36}$", "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "call": r"^\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}$|^[0-9]{3}([\x20.-])[0-9]{3}\1[0-9]{4}$|^\(?0[0-9]{1,4}\)?[\x20/-][0-9\x20]{6,9}$", "born": r"^.*$", "name": r"\p{Lu}\p{Ll}+[\x20-]\p{Lu}\p{Ll}+$",
}
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
SEEN = "array<struct<kind:string,start:bigint,end:bigint,votes:array<int>,shape:array<double>>>"


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# --- where patterns match ------------------------------------------------------------------------------------------------


def running(steps: Column, chunk: int = 256) -> Column:
    """Sums of the first 1, 2, ... elements of an array of longs. In chunks, so that long arrays aren't copied for each."""

    def sums(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")))))

    def joined(chunks: Column) -> Column:
        ends = F.transform(chunks, lambda c: F.element_at(c, -1))
        before = F.concat(F.array(F.lit(0).cast("long")), sums(ends))
        return F.flatten(F.transform(chunks, lambda c, i: bound(F.element_at(before, i + 1), lambda b: F.transform(c, lambda x: x + b))))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / chunk).cast("int")), lambda k: sums(F.slice(steps, k * chunk + 1, chunk)))
    return F.when(F.size(steps) == 0, F.array().cast("array<bigint>")).otherwise(bound(chunks, joined))


def located(df: DataFrame, name: str, pattern: str, needs: str | None = None) -> DataFrame:
    """df with `name`: the pattern's leftmost matches in `text` that don't overlap, as start, end, match, left and right."""
    c, none = F.col, F.array()
    has = F.contains("text", F.lit(needs)) if needs else F.lit(True)
    df = df.withColumn("_found", F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none.cast("array<string>")))
    df = df.withColumn("_pieces", F.when(F.size("_found") > 0, F.split("text", pattern, -1)).otherwise(none.cast("array<string>")))
    steps = F.transform("_found", lambda _, i: F.length(F.get("_pieces", i)).cast("long") + F.when(i > 0, F.length(F.get("_found", i - 1))).otherwise(0))
    df = df.withColumn("_starts", running(steps))
    row = lambda m, i: F.struct(F.get("_starts", i).alias("start"), (F.get("_starts", i) + F.length(m)).alias("end"), m.alias("match"), F.right(F.get("_pieces", i), F.lit(CONTEXT)).alias("left"), F.left(F.get("_pieces", i + 1), F.lit(CONTEXT)).alias("right"))
    return df.withColumn(name, F.transform("_found", row)).drop("_found", "_pieces", "_starts")


# --- checks ------------------------------------------------------------------------------------------------------------


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(1)))


def luhn(text: Column) -> Column:
    """Whether a number with a digit at least passes: every second digit from the right doubled, its digits summed."""

    def total(own: Column) -> Column:
        twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.aggregate(F.transform(own, lambda d, i: F.when(i % 2 == 1, twice(d)).otherwise(d)), F.lit(0), lambda acc, d: acc + d)

    return total(F.transform(chars(F.reverse(digits(text))), lambda d: d.cast("int"))) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN's check digits hold."""

    def rest(own: Column) -> Column:
        value = lambda x: F.when(x.between("0", "9"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
        return F.aggregate(chars(own), F.lit(0), lambda acc, x: (acc * F.when(x.between("0", "9"), 10).otherwise(100) + value(x)) % 97)

    return bound(F.replace(text, F.lit(" "), F.lit("")), lambda own: rest(F.concat(F.substring(own, F.lit(5), F.length(own)), F.left(own, F.lit(4)))) == 1)


def passes(kind: str, text: Column) -> Column:
    """Whether a base match is a span."""
    if kind == "ip":
        return F.rlike(text, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    if kind == "card":
        return luhn(text)
    return F.length(digits(text)).between(8, 15) if kind == "phone" else F.lit(True)


# --- labelers ----------------------------------------------------------------------------------------------------------


def labeled(kind: str, m: Column, left: Column, right: Column) -> Column:
    """The votes of LABELERS on a match, in that order."""
    vote = lambda cond, yes, no=0: F.when(cond, yes).otherwise(no)
    like = lambda text, pattern: F.rlike(text, F.lit(pattern))
    none = F.lit(0)

    def dated() -> Column:
        part = lambda pattern, most: F.coalesce(F.regexp_extract(m, pattern, 1).try_cast("int").between(1, most), F.lit(False))
        first, second = r"^([0-9]+)[./-]", r"^[0-9]+[./-]([0-9]+)"
        return F.when(like(m, "^[0-9]{4}"), part("-([0-9]{2})-", 12) & part("-([0-9]{2})$", 31)).otherwise(part(first, 31) & part(second, 12) | part(first, 12) & part(second, 31))

    form = none if kind == "born" else vote(like(m, FORMS[kind]), 1, -1 if kind in ("email", "ip") else 0)
    if kind in ("ip", "card", "phone"):
        check = vote(passes(kind, m), 1, -1)
    elif kind == "ssn":
        check = vote(like(m, "^(?:000|666|9..)|-00-|0000$"), -1, 1)
    else:
        held = {"iban": lambda: mod97(m), "born": dated, "call": lambda: F.length(digits(m)).between(9, 12)}.get(kind)
        check = vote(held(), 1, -1) if held else none
    if kind in ("email", "mail"):
        gazetteer = vote(F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(TLDS), 1, -1)
    elif kind == "iban":
        gazetteer = vote(F.left(m, F.lit(2)).isin(COUNTRIES), 1, -1)
    elif kind == "phone":
        gazetteer = vote(like(m, rf"^\+(?:{CODES})"), 1)
    else:
        gazetteer = vote(F.exists(F.split(m, r"[\x20.-]+"), lambda w: w.isin(GIVEN)), 1) if kind == "name" else none
    personal = vote(like(left, f"(?iu)(?:{PERSONAL[kind]})[^\\n]*$"), 1)
    other = vote(like(left, f"(?iu)(?<![\\p{{L}}])(?:{OTHER})[\\p{{L}}.:#\\x20-]{{0,12}}$"), -1)
    unit = vote(like(right, r"(?iu)^\x20?(?:%|‰|€|\$|£|°|x\x20|kg|km|cm|mm|ms|gb|mb|usd|eur|pages?\b|items?\b)") | like(left, r"[€$£#=/*]\x20?$"), -1)
    return F.array(form, check, gazetteer, personal, other, unit).cast("array<int>")


def shaped(kind: str, m: Column, votes: Column) -> Column:
    """What the classifier sees: 1, the kind, what labelers saw, length, letters and separators, each 0 or 1."""
    flags = [F.lit(True), *(F.lit(kind == k) for k in KINDS)]
    for i in range(len(LABELERS)):
        flags += [F.get(votes, F.lit(i)) > 0, F.get(votes, F.lit(i)) < 0]
    flags += [F.length(m) >= 12, F.length(m) >= 20, F.rlike(m, F.lit(r"\p{L}")), F.rlike(m, F.lit(r"[\x20()-]"))]
    return F.array(*(f.cast("double") for f in flags))


def seen(kind: str, spans: Column) -> Column:
    """Spans of a kind with their votes and shape."""

    def one(span: Column) -> Column:
        votes = labeled(kind, span["match"], span["left"], span["right"])
        return bound(votes, lambda v: F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), v.alias("votes"), shaped(kind, span["match"], v).alias("shape")))

    return F.transform(spans, one).cast(SEEN)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans by kind, then start), seen (all candidates with votes and shape, those of further kinds that touch a
    base span left out) of each row."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for kind, pattern in BASE.items():
        rows = located(rows, f"_{kind}", pattern, NEEDS.get(kind))
    rows = located(rows, "_further", _ANY).drop("text")
    spans = lambda kind: F.transform(F.filter(f"_{kind}", lambda s: passes(kind, s["match"])), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = rows.withColumn("base", F.concat(*map(spans, BASE)).cast(SPAN))
    kind_of = lambda m: F.coalesce(*(F.when(F.rlike(m, F.lit(f"^(?:{p})$")), k) for k, p in FURTHER.items()), F.lit("mail"))
    free = F.filter("_further", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.withColumn("_free", F.transform(free, lambda s: F.struct(kind_of(s["match"]).alias("kind"), s.alias("span"))))
    of = lambda kind: F.transform(F.filter("_free", lambda s: s["kind"] == kind), lambda s: s["span"])
    return rows.select("doc_id", "base", F.concat(*(seen(k, F.col(f"_{k}")) for k in BASE), *(seen(k, of(k)) for k in FURTHER)).alias("seen"))


# --- fits over patterns ------------------------------------------------------------------------------------------------


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def likelihood(votes: Column, model: Column) -> Column:
    """That a candidate with these votes is personal: the odds of its kind times those of each vote."""
    return _sigmoid(model["kind"] + _sum(F.zip_with(votes, model["odds"], lambda v, o: F.element_at(o, v + 2))))


def reliabilities(patterns: Column) -> Column:
    """struct(odds, kind): the log odds that each labeler's -1, 0 and +1 speak for, and those of a candidate as such, of an
    array of (votes, n), the patterns of a kind.

    A labeler is known by how often it casts each vote on what is personal and on what isn't. It is held to be no worse than
    MOST_DOUBT and LEAST_FAITH say, which also tells the two classes apart."""

    def step(model: Column) -> Column:
        weighed = F.transform(patterns, lambda p: bound(likelihood(p["votes"], model), lambda q: F.struct(p["votes"].alias("votes"), (p["n"] * q).alias("yes"), (p["n"] * (1 - q)).alias("no"))))

        def update(rows: Column) -> Column:
            def cast(i: int, v: int, side: str) -> Column:
                prior = (PRIOR_YES if side == "yes" else PRIOR_NO)[v] * PRIOR_VOTES
                return F.aggregate(rows, F.lit(prior), lambda acc, r: acc + F.when(F.get(r["votes"], F.lit(i)) == v, r[side]).otherwise(0.0))

            def of(i: int) -> Column:
                def odds(c: Column) -> Column:
                    at = lambda k: F.get(c, F.lit(k))
                    ratio = lambda k: F.log(at(k) / (at(0) + at(1) + at(2))) - F.log(at(k + 3) / (at(3) + at(4) + at(5)))
                    nothing = F.lit(math.log(LEAST_NOTHING))
                    return F.array(F.least(ratio(0), F.lit(math.log(MOST_DOUBT[i]))), F.greatest(nothing, F.least(-nothing, ratio(1))), F.greatest(ratio(2), F.lit(math.log(LEAST_FAITH))))

                return bound(F.array(*(cast(i, v, side) for side in ("yes", "no") for v in (-1, 0, 1))), odds)

            every = lambda side: F.aggregate(rows, F.lit(PRIOR_KIND), lambda acc, r: acc + r[side])
            share = F.greatest(F.lit(-MOST_KIND), F.least(F.lit(MOST_KIND), F.log(every("yes") / every("no"))))
            return F.struct(F.array(*map(of, range(len(LABELERS)))).alias("odds"), share.alias("kind"))

        return bound(weighed, update)

    begun = F.array(*(F.lit(math.log(PRIOR_YES[v] / PRIOR_NO[v])) for v in (-1, 0, 1)))
    begin = F.struct(F.array(*[begun] * len(LABELERS)).alias("odds"), F.lit(0.0).alias("kind"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(EM_STEPS)), begin, lambda model, _: step(model))


def weights(patterns: Column, size: int) -> Column:
    """Weights of the logistic classifier of an array of (shape, n, q), q the likelihood: steps bounded by the loss's curvature."""
    zeros = F.array(*[F.lit(0.0)] * size)
    total = lambda of: F.aggregate(patterns, zeros, lambda acc, p: bound(of(p), lambda y: F.zip_with(acc, p["shape"], lambda a, x: a + x * y)))
    most = F.aggregate(patterns, F.lit(1.0), lambda acc, p: F.greatest(acc, _sum(p["shape"])))
    curvature = F.transform(total(lambda p: p["n"]), lambda x: x * 0.25 * most + SHRINK)

    def fit(curve: Column) -> Column:
        def step(w: Column) -> Column:
            slope = total(lambda p: p["n"] * (p["q"] - _sigmoid(_dot(w, p["shape"]))))
            return F.transform(F.arrays_zip(w.alias("w"), slope.alias("s"), curve.alias("c")), lambda x: x["w"] + (x["s"] - SHRINK * x["w"]) / x["c"])

        return F.aggregate(F.sequence(F.lit(1), F.lit(FIT_STEPS)), zeros, lambda w, _: step(w))

    return bound(curvature, fit)


def reliable(rows: DataFrame) -> DataFrame:
    """kind, model and patterns (votes, shape, n) of each kind of candidates. They are counted by pattern first, of which
    there are as many as votes and shapes go together, whatever the table's size."""
    counted = rows.select(F.explode("seen").alias("s")).groupBy("s.kind", "s.votes", "s.shape").agg(F.count("*").cast("double").alias("n"))
    kinds = written(counted.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "shape", "n"))).alias("patterns")))
    return written(kinds.withColumn("model", reliabilities(F.col("patterns"))))


def fitted(kinds: DataFrame) -> DataFrame:
    """One row: w, the weights of the classifier, fitted to the likelihoods of all kinds' patterns."""
    judged = F.transform("patterns", lambda p: F.struct(p["shape"].alias("shape"), p["n"].alias("n"), likelihood(p["votes"], F.col("model")).alias("q")))
    one = written(kinds.select(judged.alias("judged")).agg(F.flatten(F.collect_list("judged")).alias("judged")).select(F.array_sort("judged").alias("judged")))
    return written(one.select(weights(F.col("judged"), 1 + len(KINDS) + 2 * len(LABELERS) + 4).alias("w")))


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and added (arrays of kind, start, end, by kind as listed, then start) of each row of docs."""
    rows = written(candidates(docs), "zstd")
    model = F.broadcast(fitted(reliable(rows)))
    good = F.filter("seen", lambda s: F.when(s["kind"].isin(list(FURTHER)), _sigmoid(_dot(s["shape"], F.col("w"))) >= LEAST_SCORE).otherwise(False))
    added = F.transform(good, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = rows.crossJoin(model).select("doc_id", "base", added.cast(SPAN).alias("all"))
    of = lambda kind: F.filter("all", lambda s: s["kind"] == kind)
    return rows.select("doc_id", "base", F.flatten(F.array(*map(of, FURTHER))).alias("added"))


def op13_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
