"""Personal data: fixed patterns, and boosted trees over high-recall candidates.

Everything on the main path is a Spark expression.  Patterns give spans by
their gaps: what ``split`` leaves between the matches tells where they begin.
Three generators propose further spans, which may overlap each other (obfuscated
addresses, loose runs of digits, tight ones), in what the fixed spans leave of a
text.

The trees learn what a pattern cannot tell.  In passages of a bounded sample of
documents, known spans (or made ones, where a passage has none) are planted after
they were corrupted: spelled or bracketed signs, other separators, lost prefixes.
Candidates that coincide with those are positive; planted dates, versions, ISBNs,
amounts, coordinates and the like, and the sample's own further candidates, are
negative.  Format and context describe a candidate; the trees are emitted as
conditional expressions, and candidates whose score passes the calibrated
threshold are added.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .boosting import Boosted, fit

#: Documents that a fit reads at most, and candidates it collects (by a hash of doc_id).
SAMPLE_DOCS, SAMPLE_CANDIDATES = 1_500, 20_000
#: Patterns.  Possessive repeats and the look-behind (or the end of the last
#: match) keep them linear without a change of what the contract's ones match.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = ["email", "ip", "card", "phone", "handle", "number", "tight"]
#: Generators of candidates.
_WORDS = "[A-Za-z0-9-]{2,}+"
_HANDLE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{2,}+"
    rf"(?:\x20?(?:@|\(at\)|\[at\])\x20?{_WORDS}(?:(?:\.|\x20\.\x20|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\x20dot\x20){_WORDS})*+"
    rf"|\x20at\x20{_WORDS}(?:(?:\x20dot\x20|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?){_WORDS})++)"
)
_NUMBER = r"(?:(?<![0-9A-Za-z])|\G)[+(]?[0-9](?:(?:[\x20().\[\]-]{0,3}|\x20?(?:\(dot\)|\[dot\])\x20?)[0-9]){6,}+(?![A-Za-z])"
_TIGHT = r"(?:(?<![0-9A-Za-z])|\G)\+?[0-9](?:[.-]?[0-9]){6,}+(?![A-Za-z])"
_NEAR = 16


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    back = F.split(F.reverse(digits), "")
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    terms = F.transform(F.filter(back, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _held(c: Column) -> Column:
    """``c`` itself, as an expression that the optimizer does not copy into filters and projections above."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def _cut(d: DataFrame, column: str, pattern: str, there: Column) -> DataFrame:
    """Add ``_gaps`` and ``_found`` of a pattern in ``column``; empty where ``there`` is false."""
    empty = F.array().cast("array<string>")
    found = F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
    return d.withColumns({"_gaps": F.when(there, F.split(column, pattern, -1)).otherwise(empty), "_found": F.when(there, found).otherwise(empty)})


def _ends(size: str) -> Column:
    """Running sums of an array of ints, 64 at a time so that long arrays are not copied for each."""
    chunk = 64

    def running(xs: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), F.array().cast("array<int>").alias("ends"))
        return F.aggregate(xs, start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["ends"], a["at"] + n).alias("ends")))

    def step(a: Column, c: Column) -> Column:
        return F.aggregate(
            F.array(running(F.slice(size, c * chunk + 1, F.lit(chunk)), a["at"])),
            a,
            lambda a, r: F.struct(r["at"].alias("at"), F.array_append(a["parts"], r["ends"]).alias("parts")),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("parts"))
    chunks = F.sequence(F.lit(0), ((F.size(size) - 1) / chunk).cast("int"))
    return F.aggregate(chunks, start, step, lambda a: F.flatten(a["parts"]))


def _spans(d: DataFrame, kind: str, column: str, pattern: str, there: Column) -> DataFrame:
    """Add ``kind``: structs of start, end (code points, end excluded), match and context."""
    d = _cut(d, column, pattern, there)
    d = d.withColumn("_size", F.zip_with(F.slice("_gaps", 1, F.size("_found")), "_found", lambda g, m: F.length(g) + F.length(m)))
    d = d.withColumn("_ends", F.when(F.size("_size") > 0, _ends("_size")).otherwise(F.array().cast("array<int>")))

    def one(m: Column, i: Column) -> Column:
        end = F.get("_ends", i)
        near = F.right(F.get("_gaps", i), F.lit(_NEAR))
        return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("m"), near.alias("before"), F.left(F.get("_gaps", i + 1), F.lit(2)).alias("after"))

    spans = F.filter(F.transform("_found", one), lambda s: _passes(kind, s["m"]))
    return d.withColumn(kind, _held(spans)).drop("_gaps", "_found", "_size", "_ends")


def _masked_kind(d: DataFrame, kind: str, column: str, pattern: str, there: Column) -> DataFrame:
    """Blank out a kind's spans in ``column``, at the same length."""
    d = _cut(d, column, pattern, there)
    one = lambda m, i: F.concat(F.get("_gaps", i), F.when(_passes(kind, m), F.repeat(F.lit("\u0001"), F.length(m))).otherwise(m))
    new = F.concat(F.array_join(F.transform("_found", one), ""), F.element_at("_gaps", -1))
    return d.withColumn(column, _held(F.when(F.size("_found") > 0, new).otherwise(F.col(column)))).drop("_gaps", "_found")


#: For every kind: its pattern and a quick test of whether it can occur.
_RULES = {
    "email": (_EMAIL, lambda c: F.contains(c, F.lit("@"))),
    "ip": (_IP, lambda c: F.col(c).rlike(r"[0-9]\.[0-9]")),
    "card": (_CARD, lambda c: F.col(c).rlike("[0-9]")),
    "phone": (_PHONE, lambda c: F.col(c).rlike(r"\+[0-9]")),
    "handle": (_HANDLE, lambda c: F.col(c).rlike(r"@|\((?:at|dot)\)|\[(?:at|dot)\]|\x20dot\x20")),
    "number": (_NUMBER, lambda c: F.col(c).rlike(r"[0-9][^0-9]{0,7}[0-9][^0-9]{0,7}[0-9]")),
    "tight": (_TIGHT, lambda c: F.col(c).rlike(r"[0-9](?:[.-]?[0-9]){6}")),
}


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def base_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text, email, ip, card, phone``: spans of the fixed patterns."""
    d = _texts(docs)
    for kind in KINDS[:4]:
        pattern, there = _RULES[kind]
        d = _spans(d, kind, "text", pattern, there("text"))
    return d


def _masked(d: DataFrame) -> DataFrame:
    """Add ``rest``: the text with fixed spans blanked out, at the same length."""
    d = d.withColumn("rest", F.col("text"))
    for kind in KINDS[:4]:
        pattern, there = _RULES[kind]
        d = _masked_kind(d, kind, "rest", pattern, there("rest"))
    return d


def candidates(d: DataFrame) -> DataFrame:
    """Add ``handle``, ``number`` and ``tight``: proposed spans outside the fixed ones."""
    d = _masked(d)
    for kind in KINDS[4:]:
        pattern, there = _RULES[kind]
        d = _spans(d, kind, "rest", pattern, there("rest"))
    return d.drop("rest")


def _features(m: Column, before: Column, after: Column) -> Column:
    """Format and context of a candidate, in the order of a model's features."""
    before = F.lower(before)
    n = F.length(m)
    plain = _digits(m)
    digits = F.length(plain)
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    spelled = m.rlike(r"\(at\)|\[at\]|\x20at\x20|\(dot\)|\[dot\]|\x20dot\x20|\[\.\]")
    told = [
        n,
        digits,
        digits / n,
        F.size(groups),
        F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        F.coalesce(F.array_min(F.transform(groups, F.length)), F.lit(0)),
        F.length(F.regexp_replace(m, r"[^.]", "")),
        F.length(F.regexp_replace(m, r"[^-]", "")),
        F.length(F.regexp_replace(m, r"[^\x20]", "")),
        F.length(F.regexp_replace(m, r"[^()\[\]]", "")),
        F.startswith(m, F.lit("+")).cast("int"),
        F.contains(m, F.lit("@")).cast("int"),
        m.rlike(r"(?:\.|dot[)\]]?)\x20?[A-Za-z]{2,12}$").cast("int"),
        m.rlike(r"[A-Za-z]{2}[^@]*(?:@|at[)\]\x20])").cast("int"),
        F.when((digits >= 12) & (digits <= 19), _luhn(plain)).otherwise(False).cast("int"),
        m.rlike(r"^(?:19|20)[0-9]{2}(?:[^0-9]|$)|[^0-9](?:19|20)[0-9]{2}$").cast("int"),
        m.rlike(r"^97[89]").cast("int"),
        (F.forall(groups, lambda g: g.rlike(f"^{_BYTE}$")) & (F.size(groups) == 4)).cast("int"),
        spelled.cast("int"),
        before.rlike(r"(?:mail|contact|write to|tel|phone|call|fax|mobile|card|visa|account|addr|host|ip)\W*$").cast("int"),
        before.rlike(r"(?:order|ref|version|isbn|no|nr|id|date|dated|on|since|v|total|sum|pages?|figure|at|by|[#$€£=*/<>])\W*$").cast("int"),
        after.rlike(r"^[.,;:)]?(?:\s|$)").cast("int"),
    ]
    return F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in told])


def planted(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, text, form, y, start, end``: passages with a corrupted span (y 1) or a harmless one (y 0).

    Every document gives a passage for each form of each kind of span; the span
    is the document's own first one of that kind, else one made of its words and
    a hash.  All are SQL expressions of the row.
    """
    d = base_spans(docs)
    digits = F.translate(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(seed).cast("string"), F.lit("pii")), 256), "abcdef", "172839")
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w).between(3, 10))
    word = lambda k: F.coalesce(F.get("words", F.pmod(F.xxhash64("doc_id", F.lit(seed + k)), F.greatest(F.size("words"), F.lit(1))).cast("int")), F.lit("lee"))
    d = d.withColumns({"d": F.coalesce(digits, F.lit("4" * 64)), "words": words, "all": F.split("text", " ")})
    d = C.write_out(d.drop("text"), "pii-parts")  # so that no later expression holds these ones many times
    part = lambda a, n: F.substring("d", a, n)
    luhn = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(F.lit("4"), F.substring("d", 1, 14), c.cast("string"))), _luhn), F.lit(0))
    octet = lambda a: F.pmod(part(a, 4).cast("int"), F.lit(256)).cast("string")
    own = lambda kind, made: F.coalesce(F.get(kind, F.lit(0))["m"], made)
    email = own("email", F.concat(word(1), F.lit("."), word(2), F.lit("@"), word(3), F.lit(".com")))
    phone = own("phone", F.concat(F.lit("+1 ("), part(3, 3), F.lit(") "), part(7, 3), F.lit("-"), part(11, 4)))
    card = _digits(own("card", luhn))
    ip = own("ip", F.concat_ws(".", octet(1), octet(9), octet(17), octet(25)))
    d = C.write_out(d.withColumns({"_email": email, "_phone": phone, "_card": card, "_ip": ip}), "pii-identities")
    email, phone, card, ip = (F.col(f"_{k}") for k in ("email", "phone", "card", "ip"))
    at = F.substring_index(email, "@", 1)
    host = F.substring_index(email, "@", -1)
    local, national = F.regexp_replace(phone, r"^\+", ""), F.regexp_replace(phone, r"^\+[0-9]+\x20", "")
    join = lambda a, b: F.concat(at, F.lit(a), F.replace(host, F.lit("."), F.lit(b)))
    fours = lambda sep: F.regexp_replace(card, "([0-9]{4})(?=[0-9])", "$1" + sep)
    bad = {
        "email": [join(" (at) ", " (dot) "), join("[at]", "[dot]"), join(" @ ", "."), join(" at ", " dot "), join("(at)", "."), join(" [at] ", " [dot] ")],
        "phone": [local, national, F.regexp_replace(local, r"[^0-9]+", "."), F.regexp_replace(local, r"[^0-9]+", " "), F.regexp_replace(local, r"[^0-9]+", "-"), F.regexp_replace(national, r"[^0-9]+", "  ")],
        "card": [fours("."), fours(" - "), fours("  "), fours("--")],
        "ip": [F.replace(ip, F.lit("."), F.lit("[.]")), F.replace(ip, F.lit("."), F.lit(" . ")), F.replace(ip, F.lit("."), F.lit("(dot)")), F.replace(ip, F.lit("."), F.lit("-"))],
    }
    two = lambda a, most: F.lpad((1 + F.pmod(part(a, 4).cast("int"), F.lit(most))).cast("string"), 2, "0")
    year = F.concat(F.lit("20"), part(5, 2))
    good = {
        "date": [F.concat(year, F.lit("-"), two(9, 12), F.lit("-"), two(13, 28)), F.concat(two(13, 28), F.lit("."), two(9, 12), F.lit("."), year), F.concat(year, two(9, 12), two(13, 28)), F.concat(year, F.lit("-"), two(9, 12), F.lit("-"), two(13, 28), F.lit(" "), two(17, 23), F.lit("."), two(21, 59))],
        "number": [F.concat_ws(".", part(1, 1), part(2, 8)), part(1, 8), F.concat(F.lit("9"), part(1, 15)), F.concat_ws("-", part(1, 4), part(5, 6)), F.concat(part(1, 2), F.lit("."), part(3, 4), F.lit(" "), part(7, 2), F.lit("."), part(9, 4)), F.concat_ws(" ", part(1, 2), part(3, 3), part(6, 3)), F.concat(F.lit("17"), part(3, 8))],
        "code": [F.concat(F.lit("978-"), part(1, 1), F.lit("-"), part(2, 2), F.lit("-"), part(4, 6), F.lit("-"), part(10, 1)), F.concat_ws(".", part(1, 1), part(2, 1), part(3, 2), part(5, 4)), F.concat(part(1, 5), F.lit("-"), part(6, 5), F.lit("-"), part(11, 5))],
        "at": [F.concat(word(4), F.lit(" @ "), part(1, 2)), F.concat(part(1, 2), F.lit(" (at) "), part(3, 2)), F.concat(part(1, 3), F.lit(" @ "), part(4, 3)), F.concat(word(4), F.lit(" @ "), word(5))],
    }
    cue = {"email": ["", "mail ", "contact: ", "write to "], "phone": ["", "call ", "tel. ", "phone: "], "card": ["", "card ", "visa: ", "account "], "ip": ["", "host ", "ip ", "addr: "], "date": ["", "on ", "since ", "dated "], "number": ["", "order ", "total ", "no. "], "code": ["", "isbn ", "version ", "ref "], "at": ["", "by ", "total ", "page "]}
    rows = []
    for y, forms in ((1, bad), (0, good)):
        for kind, ways in forms.items():
            for k, way in enumerate(ways):
                lead = F.element_at(F.array(*[F.lit(x) for x in cue[kind]]), (F.pmod(F.xxhash64("doc_id", F.lit(f"{kind}{k}{seed}")), F.lit(4)) + 1).cast("int"))
                rows.append(F.struct(F.lit(f"{kind} {k}").alias("form"), F.lit(y).alias("y"), lead.alias("lead"), way.alias("span")))
    begin = lambda a: F.array_join(F.slice("all", F.lit(a), F.lit(6)), " ")
    d = d.select("doc_id", begin(1).alias("before"), begin(8).alias("after"), F.explode(F.array(*rows)).alias("p")).select("doc_id", "before", "after", "p.*")
    start = F.length("before") + 1 + F.length("lead")
    return d.select("doc_id", "form", "y", F.concat("before", F.lit(" "), "lead", "span", F.lit(" "), "after").alias("text"), start.alias("start"), (start + F.length("span")).alias("end"))


def _sample(docs: DataFrame, rows: int, seed: int) -> DataFrame:
    share = min(1.0, rows / max(docs.count(), 1))
    return docs.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * share)).where("doc_id is not null")


def _labelled(passages: DataFrame) -> DataFrame:
    """``doc_id, form, m, before, after, y`` of all candidates; positive if they coincide with a corrupted span."""
    where = F.struct("doc_id", "form", "y", "start", "end")
    d = candidates(base_spans(passages.select(where.alias("doc_id"), "text")))
    d = d.select(F.col("doc_id").alias("w"), F.explode(F.concat(*[F.col(k) for k in KINDS[4:]])).alias("c"))
    both = F.least(F.col("c.end"), F.col("w.end")) - F.greatest(F.col("c.start"), F.col("w.start"))
    same = (both >= 0.8 * (F.col("w.end") - F.col("w.start"))) & (both >= 0.8 * (F.col("c.end") - F.col("c.start")))
    return d.select("w.doc_id", "w.form", "c.m", "c.before", "c.after", F.when(same, F.col("w.y")).otherwise(0).alias("y"))


def learn(docs: DataFrame, rows: int = SAMPLE_DOCS, most: int = SAMPLE_CANDIDATES, seed: int = 0) -> Boosted | None:
    """Fit the trees on candidates in passages of at most about ``rows`` documents, and in those documents."""
    some = C.write_out(_sample(docs.select("doc_id", "text"), rows, seed), "pii-sample")
    whole = some.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("own").alias("form"), F.lit(0).alias("y"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    given = planted(some, seed).unionByName(whole)
    c = _labelled(C.write_out(given, "pii-passages"))
    c = c.orderBy(F.xxhash64("doc_id", "form", "m", F.lit(seed)), "doc_id", "form", "m", "y").limit(most)
    got = c.select("y", _features(F.col("m"), F.col("before"), F.col("after")).alias("f")).collect()
    if not got:
        return None
    table = np.array(sorted([r.y, *r.f] for r in got))
    return fit(table[:, 1:], table[:, 0] > 0, trees=24, seed=seed)


def measure(docs: DataFrame, model: Boosted, seed: int = 1) -> DataFrame:
    """``form, y, n, found``: planted spans of each form in ``docs``, and how many the model adds.

    For spans of ``y`` 1 an added span must coincide with it; for harmless ones
    any added span that overlaps it counts.
    """
    p = C.write_out(planted(docs.where("doc_id is not null").select("doc_id", "text"), seed), "pii-measured")
    got = find(p.select(F.struct("doc_id", "form", "y", "start", "end").alias("doc_id"), "text"), model)
    w = got.select("doc_id.*", "spans")
    both = lambda s: F.least(s["end"], "end") - F.greatest(s["start"], "start")
    hit = F.exists("spans", lambda s: F.when(F.col("y") == 1, both(s) >= 0.8 * (F.col("end") - F.col("start"))).otherwise(both(s) > 0))
    return w.groupBy("form", "y").agg(F.count("*").alias("n"), F.count_if(hit).alias("found"))


def _accepts(model: Boosted):
    def accept(m: Column, before: Column, after: Column) -> Column:
        # one features array per candidate; the trees look up its entries
        scored = F.transform(F.array(_features(m, before, after)), lambda f: model.column(lambda i: f[i]))
        return F.coalesce(F.get(scored, F.lit(0)) >= model.threshold, F.lit(False))

    return accept


def find(docs: DataFrame, model: Boosted | None) -> DataFrame:
    """Base spans and all spans of every document.

    Returns ``doc_id, text, email, ip, card, phone, base, spans``; ``base`` and
    ``spans`` hold structs of start, kind (its number in ``KINDS``) and end,
    sorted by start, then kind.  ``docs`` needs ``doc_id`` and ``text``; other
    columns are ignored.  A null or empty text has no spans; a null doc_id stays
    null; rows that repeat a doc_id are read each on its own; an empty table
    gives an empty result; without a model ``spans`` are the base ones.
    """
    d = base_spans(docs)
    plain = lambda kind, a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))
    extra = []
    if model is not None:
        d, accept = candidates(d), _accepts(model)
        extra = [plain(k, F.filter(k, lambda c: accept(c["m"], c["before"], c["after"]))) for k in KINDS[4:]]
    d = d.withColumn("base", _held(F.sort_array(F.concat(*[plain(k, k) for k in KINDS[:4]]))))
    return d.withColumn("spans", _held(F.sort_array(F.concat("base", *extra))) if extra else F.col("base")).drop(*KINDS[4:])


def told(spans: str) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _union(spans: Column) -> Column:
    """Sorted spans with overlapping ones made one, of the first one's kind."""
    apart = ~F.exists(F.sequence(F.lit(1), F.greatest(F.size(spans) - 1, F.lit(1))), lambda i: F.coalesce(F.get(spans, i)["start"] < F.get(spans, i - 1)["end"], F.lit(False)))

    def add(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        longer = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] > s["start"]), F.array_append(F.slice(a, 1, F.size(a) - 1), longer)).otherwise(F.array_append(a, s))

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when((F.size(spans) < 2) | apart, spans).otherwise(F.aggregate(spans, none, add))


def _rebuilt(text: Column, spans: Column) -> Column:
    """``text`` with each of its disjoint ``spans`` replaced by the kind's name."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def pieces(cut) -> Column:
        kept = F.transform(spans, lambda s, i: F.concat(cut(F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), s["start"]), F.element_at(names, s["kind"] + 1)))
        return F.concat(F.array_join(kept, ""), cut(F.element_at(spans, -1)["end"], F.length(text)))

    # a substring is sought from the text's begin, so texts with many spans are cut by letters instead
    few = pieces(lambda a, b: F.substring(text, a + 1, b - a))
    many = F.get(F.transform(F.array(F.split(text, "")), lambda c: pieces(lambda a, b: F.array_join(F.slice(c, a + 1, b - a), ""))), F.lit(0))
    return F.when(F.size(spans) == 0, text).when(F.size(spans) <= 64, few).otherwise(many)


def redact(docs: DataFrame, model: Boosted | None) -> DataFrame:
    """``docs`` with every span of ``text`` that :func:`find` gives replaced by its kind in brackets.

    Overlapping spans are replaced as one, by the name of the first.  A null text
    stays null, an empty one empty; repeated rows are redacted each on its own;
    other columns stay as they are, whatever their names; an empty table gives an
    empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d = find(docs.select(row.alias("doc_id"), "text"), model).withColumn("spans", _held(_union(F.col("spans"))))
    new = _held(F.when(F.col("doc_id.text").isNotNull(), _rebuilt(F.col("text"), F.col("spans"))))
    return d.select(*[new.alias(c) if c == "text" else F.col("doc_id")[c].alias(c) for c in docs.columns])
