"""Personal data in texts, by built-in functions alone.

Regular expressions propose spans, validators (number ranges, digit counts, Luhn, mod 97) confirm
them, and context words near a span move its score. The patterns for the JVM use
possessive repeats and anchored starts: the same leftmost non-overlapping matches as the plain
patterns, in time linear in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters before and after a span in which context words count.
BEFORE, AFTER = 40, 24
#: Spans of the kinds that the base does not have need this score.
THRESHOLD = 60


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # as in the contract
    fast: str  # the same matches, for java.util.regex; for step, its group 1 as a match from every start
    needs: str  # a character that every match holds, or ""
    valid: str  # SQL over the match m, "" if any match will do
    score: int  # of a confirmed match without context
    context: str  # words that raise the score
    against: str  # words that lower it
    base: bool = True
    step: int = 0  # characters that fast takes up where matches may overlap


DIGITS = "regexp_replace(m, '[^0-9]', '')"
LUHN = (
    f"length({DIGITS}) BETWEEN 13 AND 19 AND aggregate(sequence(1, length({DIGITS})), 0, (a, i) -> a + "
    f"CASE WHEN i % 2 = 1 THEN int(substring(reverse({DIGITS}), i, 1)) "
    f"WHEN int(substring(reverse({DIGITS}), i, 1)) > 4 THEN 2 * int(substring(reverse({DIGITS}), i, 1)) - 9 "
    f"ELSE 2 * int(substring(reverse({DIGITS}), i, 1)) END) % 10 = 0"
)
OCTET = "^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"
MOVED = "concat(substring(replace(m, ' ', ''), 5), substring(replace(m, ' ', ''), 1, 4))"
MOD97 = (
    f"aggregate(split({MOVED}, ''), 0L, (a, c) -> CASE WHEN c = '' THEN a WHEN c BETWEEN '0' AND '9' THEN (a * 10 + ascii(c) - 48) % 97 "
    "ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1"
)

#: Characters of an IBAN by country: those of the registry, then those in use without an entry there.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_SIZES |= {n: f"{IBAN_SIZES[n]} {more}" for n, more in {25: "AO CV GW MZ", 26: "DZ IR", 27: "CF CG CM GA GQ KM MG TD", 28: "BF BJ CI MA ML NE SN TG"}.items()}
IBAN = "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_SIZES.items())

#: The four kinds of the base in their order, then the kinds that context and checksums add.
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "", 70, "email|mail|contact|write", "example"),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", f"forall(split(m, '[.]'), x -> x RLIKE '{OCTET}')", 60, "ip|host|server|address|login", "version|release|section"),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[ -]?+[0-9])++", "", LUHN, 80, "card|visa|mastercard|credit|payment", "order|isbn|serial"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", "+", f"length({DIGITS}) BETWEEN 9 AND 15", 70, "phone|tel|call|mobile|fax", "total|sum"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}", rf"(?=[A-Z]{{2}}[0-9]{{2}})(?=({IBAN})(?![A-Z0-9]))[A-Z]{{2}}", "", MOD97, 70, "iban|account|bank|konto", "serial", False, 2),
    Kind("local", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", "", "", 40, "phone|tel|call|mobile|fax", "order|isbn|serial", False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", "substring(m, 1, 3) NOT IN ('000', '666') AND substring(m, 1, 1) <> '9' AND substring(m, 5, 2) <> '00' AND substring(m, 8, 4) <> '0000'", 40, "ssn|social", "order|isbn|serial", False),
    Kind("secret", r"[0-9a-f]{32,128}", r"[0-9a-f]{32,128}+", "", "m RLIKE '[0-9]' AND m RLIKE '[a-f]'", 50, "token|secret|key|password|passwd|pwd|auth|bearer|credential", "commit|checksum|digest|revision", False),
    Kind("key", r"(AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36})", r"AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}", "", "", 70, "token|secret|key|password|auth|bearer|credential", "example", False),
)
BASE = tuple(k for k in KINDS if k.base)
RAISE, LOWERED = 20, 15
#: Matches of a run and characters of a piece, so that work on a long text is not quadratic in its size.
RUN, PIECE = 256, 512


def _near(words: str) -> str:
    return f"(^|[^a-z])({words})([^a-z]|$)"


def _look(at: str, size: str) -> str:
    """SQL of `size` characters (at most PIECE) of the text from `at`, by its pieces."""
    part = [f"coalesce(get(__pieces, int(({at}) div {PIECE}) + {k}), '')" for k in (0, 1)]
    return f"substring(concat({part[0]}, {part[1]}), int(({at}) % {PIECE}) + 1, {size})"


def spans(docs: DataFrame) -> DataFrame:
    """docs' doc_id and text with __<kind>: the confirmed spans of a kind as array<struct<s, e, score>>.

    Positions are code points from 0, ends exclusive. Null and empty texts have no spans. Matches that a
    validator refuses are dropped, never retried shorter. Base kinds keep every confirmed span
    whatever its score; other kinds need THRESHOLD and may not overlap a base span. An IBAN has exactly its
    country's size, no capital or digit right behind it, and is tried at every start: a candidate that fails takes
    nothing from one inside it, and two that overlap and are both valid are both kept. Repeated rows
    are treated each on their own; an empty table gives no rows.
    """
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    found = {}
    for k in KINDS:
        hit = F.regexp_extract_all("__text", F.lit(k.fast), F.lit(int(k.step > 0)))
        found[f"__m_{k.name}"] = F.when(F.contains("__text", F.lit(k.needs)), hit) if k.needs else hit
    out = out.withColumns(found)
    between = {f"__p_{k.name}": F.when(F.size(f"__m_{k.name}") > 0, F.split("__text", k.fast, -1)) for k in KINDS}
    out = out.withColumns(between)
    items = {
        f"__i_{k.name}": F.expr(f"zip_with(__m_{k.name}, slice(__p_{k.name}, 1, size(__m_{k.name})), (m, p) -> struct(m, {k.step or 'length(m)'} AS n, length(p) AS p))")
        for k in KINDS
    }
    out = out.withColumns(items)
    # positions are sums over what came before: first of whole runs of matches, then inside each run
    runs = {
        f"__r_{k.name}": F.expr(f"""
            aggregate(sequence(1, size(__i_{k.name}), {RUN}), struct(0 AS at, CAST(array() AS array<int>) AS got),
              (a, i) -> struct(a.at + aggregate(slice(__i_{k.name}, i, {RUN}), 0, (t, x) -> t + x.p + x.n) AS at, concat(a.got, array(a.at)) AS got), a -> a.got)""")
        for k in KINDS
    }
    out = out.withColumns({c: F.when(F.size(c.replace("__r_", "__i_")) > 0, r) for c, r in runs.items()})
    placed = {}
    for k in KINDS:
        placed[f"__s_{k.name}"] = F.expr(f"""
            coalesce(flatten(transform(__r_{k.name}, (start, r) -> aggregate(slice(__i_{k.name}, r * {RUN} + 1, {RUN}),
              struct(start AS at, CAST(array() AS array<struct<s:int,e:int,m:string>>) AS got),
              (a, x) -> struct(a.at + x.p + x.n AS at, concat(a.got, array(struct(a.at + x.p AS s, a.at + x.p + length(x.m) AS e, x.m AS m))) AS got),
              a -> a.got))), CAST(array() AS array<struct<s:int,e:int,m:string>>))""")
    out = out.withColumns(placed)
    confirmed = {}
    for k in KINDS:
        valid = f"exists(array(x.m), m -> {k.valid})" if k.valid else "true"
        confirmed[f"__v_{k.name}"] = F.expr(f"filter(__s_{k.name}, x -> {valid})")
    out = out.withColumns(confirmed)
    # context is read from short pieces: a look into a long text counts its characters from the first
    some = F.expr(" + ".join(f"size(__v_{k.name})" for k in KINDS) + " > 0")
    out = out.withColumn("__pieces", F.when(some, F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    scored = {}
    for k in KINDS:
        near = f"concat({_look(f'greatest(x.s - {BEFORE}, 0)', f'least(x.s, {BEFORE})')}, ' ', {_look('x.e', str(AFTER))})"
        near = f"translate({near}, '{UPPER}', '{LOWER}')"
        score = f"{k.score} + if({near} RLIKE '{_near(k.context)}', {RAISE}, 0) - if({near} RLIKE '{_near(k.against)}', {LOWERED}, 0)"
        scored[f"__{k.name}"] = F.expr(f"transform(__v_{k.name}, x -> struct(x.s AS s, x.e AS e, {score} AS score))")
    out = out.withColumns(scored)
    for k in KINDS:
        if not k.base:
            clear = " AND ".join(f"NOT exists(__{b.name}, y -> y.s < x.e AND x.s < y.e)" for b in BASE)
            out = out.withColumn(f"__{k.name}", F.expr(f"filter(__{k.name}, x -> x.score >= {THRESHOLD} AND {clear})"))
    return out


def _joined(kinds: tuple[Kind, ...], scores: bool = False) -> Column:
    parts = ", ".join(f"transform(__{k.name}, x -> concat_ws(':', '{k.name}', x.s, x.e{', x.score' if scores else ''}))" for k in kinds)
    return F.expr(f"array_join(concat({parts}), ',')")


def find(docs: DataFrame) -> DataFrame:
    """One row per document: counts of all kinds, of all spans, a digest of the base kinds' spans, all spans and their scores."""
    out = spans(docs)
    counts = [F.size(f"__{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS]
    return out.select(
        "doc_id", *counts, F.expr(" + ".join(f"size(__{k.name})" for k in KINDS)).cast("long").alias("n_spans"), F.sha2(_joined(BASE), 256).alias("base_sha256"),
        _joined(KINDS).alias("spans"), _joined(KINDS, True).alias("scored_spans"),
    )


def redact(docs: DataFrame, mark: str = "[PII]") -> DataFrame:
    """docs with every span, overlapping ones merged, replaced in text by the mark; null texts stay null."""
    cut = spans(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"))
    all_of = ", ".join(f"transform(__{k.name}, x -> struct(x.s, x.e))" for k in KINDS)
    cut = cut.withColumn("__cut", F.expr(f"array_sort(concat({all_of}))"))
    done = F.expr(f"""aggregate(__cut, struct(0 AS at, CAST('' AS string) AS got),
        (a, x) -> CASE WHEN x.e <= a.at THEN a WHEN x.s < a.at THEN struct(x.e AS at, a.got AS got)
          ELSE struct(x.e AS at, concat(a.got, substring(__text, a.at + 1, x.s - a.at), '{mark}') AS got) END,
        a -> concat(a.got, substring(__text, a.at + 1)))""")
    text = F.when(F.col("doc_id.text").isNotNull(), done).alias("text")
    return cut.select(*[text if c == "text" else F.col("doc_id")[c].alias(c) for c in docs.columns])


def _oracle() -> str:
    """The SQL has the IBAN pattern without sizes: it misses IBANs with a capital or digit one blank behind them."""
    digits = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    luhn = (
        f"length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: "
        f"CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({digits}), CAST(i AS INT), 1) AS INT) "
        f"WHEN CAST(substr(reverse({digits}), CAST(i AS INT), 1) AS INT) > 4 THEN 2 * CAST(substr(reverse({digits}), CAST(i AS INT), 1) AS INT) - 9 "
        f"ELSE 2 * CAST(substr(reverse({digits}), CAST(i AS INT), 1) AS INT) END)) % 10 = 0"
    )
    moved = "substr(replace(x.m, ' ', ''), 5) || substr(replace(x.m, ' ', ''), 1, 4)"
    mod97 = (
        f"list_reduce(list_transform(string_split({moved}, ''), lambda c: CAST(ascii(c) AS BIGINT)), "
        "lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END, CAST(0 AS BIGINT)) = 1"
    )
    checks = {
        "email": "true", "local": "true", "key": "true", "secret": "regexp_matches(x.m, '[0-9]') AND regexp_matches(x.m, '[a-f]')", "card": luhn, "iban": mod97,
        "ip": f"list_bool_and(list_transform(string_split(x.m, '.'), lambda o: regexp_matches(o, '{OCTET}')))",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "ssn": "substr(x.m, 1, 3) NOT IN ('000', '666') AND substr(x.m, 1, 1) <> '9' AND substr(x.m, 5, 2) <> '00' AND substr(x.m, 8, 4) <> '0000'",
    }
    hits = ", ".join(f"regexp_extract_all(text, '{k.pattern}') AS m_{k.name}, string_split_regex(text, '{k.pattern}') AS p_{k.name}" for k in KINDS)
    placed = ", ".join(
        f"list_transform(range(1, len(m_{k.name}) + 1), lambda i: {{'s': CAST(list_sum(list_transform(p_{k.name}[1:i], lambda y: length(y))) "
        f"+ coalesce(list_sum(list_transform(m_{k.name}[1:i - 1], lambda y: length(y))), 0) AS BIGINT), 'm': m_{k.name}[i]}}) AS s_{k.name}"
        for k in KINDS
    )
    scored = []
    for k in KINDS:
        near = f"translate(substr(text, greatest(x.s - {BEFORE}, 0) + 1, least(x.s, {BEFORE})) || ' ' || substr(text, x.s + length(x.m) + 1, {AFTER}), '{UPPER}', '{LOWER}')"
        score = f"{k.score} + CASE WHEN regexp_matches({near}, '{_near(k.context)}') THEN {RAISE} ELSE 0 END - CASE WHEN regexp_matches({near}, '{_near(k.against)}') THEN {LOWERED} ELSE 0 END"
        scored.append(f"list_transform(list_filter(s_{k.name}, lambda x: {checks[k.name]}), lambda x: {{'s': x.s, 'e': x.s + length(x.m), 'score': {score}}}) AS a_{k.name}")
    clear = "list_concat(" + ", ".join(f"a_{b.name}" for b in BASE) + ")"
    final = ", ".join(
        f"a_{k.name} AS f_{k.name}" if k.base else f"list_filter(a_{k.name}, lambda x: x.score >= {THRESHOLD} AND len(list_filter({clear}, lambda y: y.s < x.e AND x.s < y.e)) = 0) AS f_{k.name}"
        for k in KINDS
    )

    def joined(kinds: tuple[Kind, ...], scores: bool = False) -> str:
        parts = [f"list_transform(f_{k.name}, lambda x: '{k.name}:' || x.s || ':' || x.e{' || chr(58) || x.score' if scores else ''})" for k in kinds]
        return f"coalesce(array_to_string(list_concat({', '.join(parts)}), ','), '')"

    counts = ", ".join(f"CAST(len(f_{k.name}) AS BIGINT) AS n_{k.name}" for k in KINDS)
    return f"""
WITH hits AS (SELECT doc_id, text, {hits} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
placed AS (SELECT doc_id, text, {placed} FROM hits),
scored AS (SELECT doc_id, {", ".join(scored)} FROM placed),
final AS (SELECT doc_id, {final} FROM scored)
SELECT doc_id, {counts}, CAST({" + ".join(f"len(f_{k.name})" for k in KINDS)} AS BIGINT) AS n_spans, sha256({joined(BASE)}) AS base_sha256, {joined(KINDS)} AS spans, {joined(KINDS, True)} AS scored_spans FROM final
"""


ORACLE = _oracle()
