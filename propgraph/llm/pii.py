"""Personal data in text, by patterns, checksums and context (DataFrame functions only).

Regular expressions propose spans, checksums confirm them (Luhn for payment cards, mod 97 for bank
accounts), and words before a span raise its score. Offsets are code points, the end exclusive.

Kinds: email, ip, card and phone are the base spans; iban, pan (a payment card inside a longer
run of digits, or of 13 to 15 digits), tel (a number without country code) and secret (a key or token,
confirmed by how many different characters it has) are added by the method where checksum or context
raise them to the threshold and no base span overlaps. Context is looked for in the ``WINDOW`` characters
before a span, but not beyond the match before it and the gap before that.

Defined cases. Null text counts as empty and has no spans. Very long texts are searched whole; the
patterns use possessive repeats, and offsets are running sums made in pieces of ``PIECE`` (:func:`_running`),
so that neither the length of a run nor the number of spans counts with its square.
Rows that repeat are searched each for itself; an empty table gives an empty result; other columns
pass through, and those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "pan", "tel", "secret")
BASE = KINDS[:4]

#: A run can only start where the character before is not of the run, or where a match has just ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9]))",  # the rest is looked at, not consumed
    "pan": r"(?<![0-9])(?:[0-9]{4}\x20[0-9]{4}\x20[0-9]{4}\x20[0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{13,19})(?![0-9])",
    "tel": r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}",
}
#: What a text must hold before a pattern is tried.
GUARDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "pan": r"[0-9]{4}", "tel": r"[0-9]{3}[\x20.-][0-9]{4}", "secret": r"[A-Za-z0-9+/_-]{20}"}
#: Words that make a kind more likely when they stand shortly before a span.
CONTEXT = {
    "email": r"mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|server|host|adresse",
    "card": r"card|visa|credit|debit|karte|tarjeta|carte",
    "phone": r"phone|call|tel|mobile|fax|telefon",
    "iban": r"iban|account|bank|konto|cuenta|compte",
    "pan": r"card|visa|amex|credit|debit|karte|tarjeta|carte",
    "tel": r"phone|call|tel\b|tel\.|mobile|fax|telefon",
    "secret": r"token|secret|passw|api.?key|access.?key|private.?key|credential|bearer|auth",
}
#: Score of a proposed span, of a passed checksum, of a context word; spans need the threshold.
PRIOR = {"email": 0.8, "ip": 0.7, "card": 0.5, "phone": 0.7, "iban": 0.5, "pan": 0.4, "tel": 0.4, "secret": 0.4}
CHECKSUM, NEARBY, THRESHOLD, WINDOW = 0.3, 0.3, 0.7, 40
#: Starts of keys that need no context word.
KNOWN_KEYS = r"^(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|rk_live_|eyJ)"
#: Different characters that a key has at least, besides letters and digits both.
DIFFERENT = 10
#: Elements of an array that are summed up in one piece.
PIECE = 64
#: Spans of a text above which it is masked by way of an array of its characters.
MANY = 200

_MATCH = "struct<match:string,start:int,end:int,before:string>"
_SPAN = "struct<kind:string,start:int,end:int,score:double,match:string>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the string of digits passes the Luhn check."""
    n = F.length(digits)
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + twice
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def mod97(account: Column) -> Column:
    """True if the account number leaves 1 modulo 97 with its first four characters at the end."""
    bare = F.regexp_replace(account, r"\x20", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, F.lit(1), F.lit(4)))
    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c <= 57, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _bound(value: Column, of) -> Column:
    """``of(value)`` with the value evaluated once, however often ``of`` mentions it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _running(values: Column, combine, start: Column) -> Column:
    """Running totals of an array, each with its own element. Growing an array copies it, so totals are
    made within pieces and over the pieces' totals: about n * PIECE + (n / PIECE)^2 steps."""

    def totals(of: Column, first: Column) -> Column:
        def step(out: Column, v: Column) -> Column:
            return F.array_append(out, combine(F.when(F.size(out) > 0, F.get(out, F.size(out) - 1)).otherwise(first), v))

        return F.aggregate(of, F.slice(F.array(first), 1, 0), step)

    pieces = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / PIECE).cast("int")), lambda k: F.slice(values, k * PIECE + 1, F.lit(PIECE))))
    inside = F.transform(pieces, lambda piece: totals(piece, start))

    def carried(sums: Column) -> Column:
        ends = F.transform(sums, lambda t: F.get(t, F.size(t) - 1))
        return _bound(F.concat(F.array(start), totals(ends, start)), lambda before: F.flatten(F.transform(sums, lambda t, k: F.transform(t, lambda v: combine(F.get(before, k), v)))))

    return F.when(F.size(values) > 0, _bound(inside, carried)).otherwise(F.slice(F.array(start), 1, 0))


def _candidates(text: Column, kind: str) -> Column:
    """All matches of a kind with their offsets, in order: array of (match, start, end, before)."""
    pattern = PATTERNS[kind]

    def placed(parts: Column) -> Column:
        found, gaps = parts["found"], parts["gaps"]
        sizes = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(g) + F.length(m))

        def with_ends(ends: Column) -> Column:
            def span(m: Column, k: Column) -> Column:
                end = F.get(ends, k)
                gap = F.right(F.get(gaps, k), F.lit(WINDOW))
                longer = F.right(F.concat(F.when(k > 0, F.concat(F.right(F.get(gaps, k - 1), F.lit(WINDOW)), F.get(found, k - 1))).otherwise(F.lit("")), gap), F.lit(WINDOW))
                return F.struct(m.alias("match"), (end - F.length(m)).alias("start"), end.alias("end"), F.when(F.length(gap) >= WINDOW, gap).otherwise(longer).alias("before"))

            return F.transform(found, span)

        return _bound(_running(sizes, lambda a, v: a + v, F.lit(0)), with_ends)

    # bound to variables, so that neither pattern nor sums are evaluated for each match
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(GUARDS[kind]), _bound(parts, placed)).otherwise(F.expr(f"cast(array() AS array<{_MATCH}>)"))


def _accounts(text: Column) -> Column:
    """Proposed bank accounts with their offsets, in order; the text after one may be part of its match, and the next may start in it."""
    rest = F.regexp_extract_all(text, F.lit(PATTERNS["iban"]), 1)
    def whole(s: Column, r: Column) -> Column:
        return F.struct(F.concat(s["match"], r).alias("match"), s["start"].alias("start"), (s["end"] + F.length(r)).alias("end"), s["before"].alias("before"))
    return F.zip_with(_candidates(text, "iban"), F.when(text.rlike(GUARDS["iban"]), rest).otherwise(F.expr("cast(array() AS array<string>)")), whole)


def _longest_accounts(spans: Column) -> Column:
    """Each proposed span cut to its longest prefix of whole groups that passes the checks; the first of overlapping ones stays."""
    def cut(s: Column) -> Column:
        groups = F.split(s["match"], r"\x20")
        prefixes = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
        return F.struct(F.get(F.filter(prefixes, lambda p: _valid("iban", p)), F.lit(0)).alias("match"), s["start"].alias("start"), s["before"].alias("before"))
    passed = F.filter(F.transform(spans, cut), lambda s: s["match"].isNotNull())
    empty = F.expr(f"struct(0 AS at, cast(array() AS array<{_MATCH}>) AS out)")

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + F.length(s["match"])
        more = F.concat(acc["out"], F.array(F.struct(s["match"].alias("match"), s["start"].alias("start"), end.alias("end"), s["before"].alias("before"))))
        free = s["start"] >= acc["at"]
        return F.struct(F.when(free, end).otherwise(acc["at"]).alias("at"), F.when(free, more).otherwise(acc["out"]).alias("out"))
    return F.aggregate(passed, empty, step, lambda acc: acc["out"])


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, r"\x20", "")).between(15, 34) & mod97(match)
    if kind == "pan":
        known = (F.length(digits) >= 16) | digits.rlike(r"^(?:3[4678]|30|4)")
        return known & luhn(digits)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(match, ""))) >= DIFFERENT)
    return F.lit(True)


def _score(kind: str, span: Column) -> Column:
    prior = F.lit(PRIOR[kind] + (CHECKSUM if kind in ("card", "iban") else 0))
    if kind == "pan":  # 16 digits and more are payment cards or chance; fewer need a context word
        prior = F.when(F.length(_digits(span["match"])) >= 16, F.lit(PRIOR[kind] + CHECKSUM)).otherwise(F.lit(PRIOR[kind] + 0.1))
    if kind == "secret":
        prior = F.when(span["match"].rlike(KNOWN_KEYS), F.lit(PRIOR[kind] + CHECKSUM)).otherwise(prior)
    return F.least(F.lit(1.0), prior + F.when(F.lower(span["before"]).rlike(CONTEXT[kind]), F.lit(NEARBY)).otherwise(F.lit(0.0)))


def _confirmed(kind: str, spans: Column) -> Column:
    """The spans that pass the checks of their kind, scored."""

    def scored(s: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _score(kind, s).alias("score"), s["match"].alias("match"))
    return F.transform(F.filter(spans, lambda s: _valid(kind, s["match"])), scored)


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _free(added: Column, base: Column) -> Column:
    """Of the added spans those that no base span overlaps.

    All are sorted by start; a span is free if the furthest end of the base spans up to it is not
    beyond its start, and the next base span does not start before its end.
    """
    far = 2**31 - 1
    marked = F.array_sort(F.concat(*[F.transform(spans, lambda s, flag=flag: F.struct(s["start"].alias("start"), F.lit(flag).alias("added"), s.alias("span"))) for spans, flag in ((base, 0), (added, 1))]))

    def sift(order: Column) -> Column:
        ends = _running(F.transform(order, lambda m: F.when(m["added"] == 0, m["span"]["end"]).otherwise(F.lit(-1))), F.greatest, F.lit(-1))
        starts = F.reverse(_running(F.reverse(F.transform(order, lambda m: F.when(m["added"] == 0, m["start"]).otherwise(F.lit(far)))), F.least, F.lit(far)))

        def kept(sums: Column) -> Column:
            free = F.filter(order, lambda m, k: (m["added"] == 1) & (F.get(sums["ends"], k) <= m["start"]) & (F.get(sums["starts"], k) >= m["span"]["end"]))
            return F.transform(free, lambda m: m["span"])

        return _bound(F.struct(ends.alias("ends"), starts.alias("starts")), kept)

    return F.when((F.size(base) == 0) | (F.size(added) == 0), added).otherwise(_bound(marked, sift))


def find_personal_data(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with ``pii``, an array of (kind, start, end, score, match): base spans and added ones."""
    own = "_pii" + "_" * max(map(len, docs.columns))  # a prefix that no column has
    out = docs.withColumn(f"{own}text", F.coalesce(docs[text_column], F.lit("")))
    text, base, added = F.col(f"{own}text"), F.col(f"{own}base"), F.col(f"{own}added")
    for kind in KINDS:  # one projection a kind, so that each pattern runs once
        out = out.withColumn(f"{own}{kind}", _accounts(text) if kind == "iban" else _candidates(text, kind))
    out = out.withColumn(f"{own}iban", _longest_accounts(F.col(f"{own}iban")))
    for kind in KINDS:
        out = out.withColumn(f"{own}{kind}", _confirmed(kind, F.col(f"{own}{kind}")))
    out = out.withColumn(f"{own}base", F.concat(*[F.col(f"{own}{k}") for k in BASE]))
    out = out.withColumn(f"{own}added", F.concat(*[F.filter(F.col(f"{own}{k}"), lambda s: s["score"] >= THRESHOLD - 1e-9) for k in KINDS[4:]]))
    out = out.withColumn(f"{own}added", _free(added, base))
    out = out.withColumn("pii", F.concat(base, *[_of_kind(added, k) for k in KINDS[4:]]).cast(f"array<{_SPAN}>"))
    return out.drop(f"{own}text", f"{own}base", f"{own}added", *[f"{own}{k}" for k in KINDS])


def mask_personal_data(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by ``[KIND]``; overlapping spans become one."""
    found = find_personal_data(docs, text_column)
    own = "_mask" + "_" * max(map(len, found.columns))
    text = F.coalesce(F.col(text_column), F.lit(""))
    spans = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # the end of what is masked already, before each span and at last
    upto = F.concat(F.array(F.lit(0)), _running(F.transform(F.col(f"{own}spans"), lambda s: s["end"]), F.greatest, F.lit(0)))
    found = found.withColumn(f"{own}spans", spans).withColumn(f"{own}upto", upto)
    found = found.withColumn(f"{own}letters", F.when(F.size("pii") > MANY, F.split(text, "")))
    spans, upto, letters = F.col(f"{own}spans"), F.col(f"{own}upto"), F.col(f"{own}letters")

    def between(a: Column, b: Column) -> Column:
        return F.when(letters.isNull(), F.substring(text, a + 1, b - a)).otherwise(F.array_join(F.slice(letters, a + 1, b - a), ""))

    def mark(s: Column, k: Column) -> Column:
        at = F.get(upto, k)
        return F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))

    last = F.get(upto, F.size(upto) - 1)
    masked = F.concat(F.array_join(F.transform(spans, mark), ""), between(last, F.greatest(F.length(text), last)))
    kept = [F.when(F.col(c).isNotNull(), masked).alias(c) if c == text_column else F.col(c) for c in docs.columns if c != "pii"]
    return found.select(*kept)


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_personal_data(docs).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(_of_kind(F.col("pii"), k)).cast("long").alias(f"n_{k}") for k in BASE]
    counts.append(F.size("pii").cast("long").alias("n_found"))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
