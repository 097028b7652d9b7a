"""Personal data: patterns propose spans, checksums confirm them, context adjusts a score.

Everything is a native expression over one row: no shuffle, no Python. Positions
are code points, ends exclusive. A null or empty text has no spans; repeated rows
are handled one by one; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opstrail.llm.common import free_name, table, whole

#: Matches whose positions are summed at once; two levels keep this linear in a text's matches.
CHUNK = 256


@dataclass(frozen=True)
class Kind:
    """``pattern`` must not need retries: repeated groups are possessive, so that long runs of
    digits cost neither stack nor quadratic time. ``needs`` is a cheap test of the whole text."""

    name: str
    pattern: str
    needs: str
    prior: float
    base: bool = True


#: Length of an account number without spaces, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    spaced = rf"(?:\x20[A-Z0-9]{{4}}){{{groups}}}" + (rf"\x20[A-Z0-9]{{{rest}}}" if rest else "")
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{length - 4}}}|{spaced})(?![A-Za-z0-9])"


#: A number of its country's length ends there, whatever word follows. Any other code takes all
#: groups up to the next such number, and a short last group only if it is a whole word.
_IBAN = "(?:" + "|".join(_iban_of(n, c) for n, c in IBAN_LENGTHS.items()) + ")"
IBAN = (
    rf"(?<![A-Za-z0-9])(?:{_IBAN}|[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}+|(?:\x20(?!{_IBAN})[A-Z0-9]{{4}}){{2,7}}+"
    r"(?:\x20[A-Z0-9]{1,3}(?![A-Za-z0-9]))?+)(?![A-Za-z0-9]))"
)
#: The kinds in the order that breaks ties.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.4),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6),
    Kind("iban", IBAN, "", 0.2, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.4, False),
)
#: Words before a span that speak for its kind, and those against any.
SPEAKING = {
    "email": "mail|contact|write to",
    "ip": r"\bip\b|address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": r"\bssn\b|social security|tax",
}
AGAINST = r"version|\bisbn\b|order|invoice|serial|part no|ticket"
CONTEXT = 40
CHECKSUM_BONUS, CONTEXT_BONUS, CONTEXT_MALUS = 0.5, 0.3, 0.3
THRESHOLD = 0.5


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a digit text is a multiple of ten."""
    seen = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(
            F.filter(seen, lambda c: c != ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
            ),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces leaves 1 when divided by 97."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(F.ascii(c) >= 65, a * 100 + F.ascii(c) - 55).otherwise(
            a * 10 + F.ascii(c) - 48
        )
        % 97,
    )
    return rest == 1


def confirmed(kind: str, match: Column) -> Column:
    """The checks that a proposed span of ``kind`` must pass."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        small = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{small}\.{small}\.{small}\.{small}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(F.lit(False))
    if kind == "ssn":
        return match.rlike(r"^(?!000|666|9)...-(?!00)..-(?!0000)....$")
    return F.lit(True)


def last(text: Column) -> Column:
    return F.substring(text, -CONTEXT, CONTEXT)


def placed(matches: Column, gaps: Column, speaking: str = "") -> Column:
    """Array of (gap, match, s, e, spoken) from the matches and the text between them.

    ``spoken`` is whether ``speaking`` is found in the ``CONTEXT`` characters before a match, earlier
    matches among them, or was for the match before, at most ``CONTEXT`` characters away: in a
    list of numbers the word before the first speaks for all. Without ``speaking`` it is null.
    """
    size = F.size(matches)
    rows = F.arrays_zip(F.slice(gaps, 1, size).alias("gap"), matches.alias("match"))
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int")),
        lambda c: F.slice(rows, c * CHUNK + 1, CHUNK),
    )
    one = "array<struct<gap:string,match:string,s:bigint,e:bigint,spoken:boolean>>"
    state = "struct<at:bigint,tail:string,spoken:boolean,out:{}>"

    def walk(chunk: Column, before: Column) -> Column:
        first = F.struct(
            before["at"].alias("at"), before["tail"].alias("tail"), before["spoken"].alias("spoken"), F.array().cast(one).alias("out")
        ).cast(state.format(one))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["gap"])
            end = begin + F.length(x["match"])
            if speaking:
                near = last(F.concat(acc["tail"], last(x["gap"])))
                spoken = F.lower(near).rlike(speaking) | (acc["spoken"] & (F.length(x["gap"]) <= CONTEXT))
                tail = last(F.concat(near, last(x["match"])))
            else:
                spoken, tail = acc["spoken"], acc["tail"]
            item = F.struct(
                x["gap"].alias("gap"), x["match"].alias("match"), begin.alias("s"), end.alias("e"), spoken.alias("spoken")
            )
            return F.struct(
                end.alias("at"), tail.alias("tail"), spoken.alias("spoken"), F.concat(acc["out"], F.array(item)).alias("out")
            ).cast(state.format(one))

        return F.aggregate(chunk, first, step)

    def join(acc: Column, chunk: Column) -> Column:
        done = walk(chunk, acc)
        return F.struct(
            done["at"].alias("at"),
            done["tail"].alias("tail"),
            done["spoken"].alias("spoken"),
            F.concat(acc["out"], F.array(done["out"])).alias("out"),
        ).cast(state.format(f"array<{one}>"))

    start = F.struct(
        F.lit(0).cast("bigint").alias("at"),
        F.lit("").alias("tail"),
        F.lit(False if speaking else None).cast("boolean").alias("spoken"),
        F.array().cast(f"array<{one}>").alias("out"),
    ).cast(state.format(f"array<{one}>"))
    return F.flatten(F.aggregate(chunks, start, join)["out"])


SPAN = "array<struct<s:bigint,k:int,e:bigint,kind:string,base:boolean,score:double>>"


def spans_of(order: int, kind: Kind, text: Column, matches: Column) -> Column:
    """The confirmed spans of one kind, scored. Words against a span count from the match before it on;
    so do those for a base kind, whose spans stay anyway."""

    def scored(x: Column) -> Column:
        near = F.lower(last(x["gap"]))
        spoken = near.rlike(SPEAKING[kind.name]) if kind.base else x["spoken"]
        score = (
            F.lit(kind.prior)
            + (CHECKSUM_BONUS if kind.name in ("card", "iban") else 0.0)
            + F.when(spoken, CONTEXT_BONUS).otherwise(0.0)
            - F.when(near.rlike(AGAINST), CONTEXT_MALUS).otherwise(0.0)
        )
        return F.struct(
            x["s"].alias("s"),
            F.lit(order).alias("k"),
            x["e"].alias("e"),
            F.lit(kind.name).alias("kind"),
            F.lit(kind.base).alias("base"),
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"),
        )

    good = F.filter(matches, lambda m: confirmed(kind.name, m))
    places = placed(matches, F.split(text, kind.pattern, -1), "" if kind.base else SPEAKING[kind.name])
    found = F.transform(F.filter(places, lambda x: confirmed(kind.name, x["match"])), scored)
    if not kind.base:
        found = F.filter(found, lambda x: x["score"] >= THRESHOLD)
    # A text without a confirmed match is not split: most texts end here.
    return F.when(F.size(good) > 0, found).otherwise(F.array().cast(SPAN)).cast(SPAN)


def find_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with the spans of personal data in ``into``.

    An array of (s, k, e, kind, base, score) ordered by start, then kind. Spans of
    base kinds stay whatever their score; others need ``THRESHOLD``. An account
    number must pass mod 97, a card number Luhn. Spans of two kinds may overlap.
    """
    body = whole(F.col(f"`{text}`"))
    held = [free_name(docs, f"found_{k.name}") for k in KINDS]
    proposed = docs.withColumns(
        {
            name: F.when(
                F.contains(body, F.lit(kind.needs)) if kind.needs else F.lit(True),
                F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0)),
            ).otherwise(F.array().cast("array<string>"))
            for name, kind in zip(held, KINDS, strict=True)
        }
    )
    by_kind = [spans_of(i, k, body, F.col(name)) for i, (name, k) in enumerate(zip(held, KINDS, strict=True))]
    some = F.greatest(*[F.size(name) for name in held]) > 0
    found = F.when(some, F.array_sort(F.flatten(F.array(*by_kind)))).otherwise(F.array().cast(SPAN))
    return proposed.withColumn(into, found).drop(*held)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span, overlapping ones as one, replaced by its first kind in brackets.

    Columns and rows stay as they are; a null text stays null.
    """
    spans = free_name(docs, "spans")
    body = F.col(f"`{text}`")
    piece = "struct<at:bigint,out:array<string>>"

    def step(acc: Column, x: Column) -> Column:
        apart = x["s"] >= acc["at"]
        between = F.substring(body, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int"))
        more = F.array(between, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(apart, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"),
        ).cast(piece)

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")).cast(piece)
    clean = F.aggregate(
        F.col(spans),
        start,
        step,
        lambda acc: F.concat(
            F.array_join(acc["out"], ""), F.substring(body, (acc["at"] + 1).cast("int"), F.length(body))
        ),
    )
    found = find_spans(docs, text, spans)
    cleaned = F.when(F.size(spans) > 0, clean).otherwise(body)
    return found.withColumn(text, cleaned).select(*[F.col(f"`{c}`") for c in docs.columns])


def is_kind(name: str):
    return lambda x: x["kind"] == name


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All personal data of all documents; one row per row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs)
    base = F.filter("spans", lambda x: x["base"])
    return found.select(
        "doc_id",
        *[
            F.size(F.filter("spans", is_kind(k.name))).cast("bigint").alias(f"n_{k.name}") for k in KINDS
        ],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def _duck_kind(order: int, kind: Kind, pattern: str, check: str) -> str:
    """DuckDB: confirmed spans of one kind, by pieces between matches."""
    return f"""
    SELECT doc_id, rid, {order} AS k, '{kind.name}' AS kind, {kind.base} AS base, s, s + length(m) AS e, m, gap FROM (
      SELECT doc_id, rid, m, gap,
        sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY i) - length(m) AS s
      FROM (SELECT doc_id, rid, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i
        FROM (SELECT doc_id, rid, regexp_extract_all(body, '{pattern}') AS ms,
                     regexp_split_to_array(body, '{pattern}') AS gaps FROM d) WHERE len(ms) > 0))
    WHERE {check}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j:
   CASE WHEN j % 2 = 1 THEN CAST(reverse({_DIGITS})[j] AS INT)
   ELSE (2 * CAST(reverse({_DIGITS})[j] AS INT)) // 10 + (2 * CAST(reverse({_DIGITS})[j] AS INT)) % 10 END)) % 10 = 0"""
_SMALL = "list_max(list_transform(string_split(m, '.'), lambda p: CAST(p AS HUGEINT))) <= 255"
_PLAIN = "replace(m, ' ', '')"
_MOD97 = rf"""length({_PLAIN}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(
   {_PLAIN}[5:] || {_PLAIN}[1:4], ''), lambda c: CASE WHEN c >= 'A' THEN ord(c) - 55 ELSE ord(c) - 48 END)),
   lambda a, v: (CASE WHEN v > 9 THEN a * 100 + v ELSE a * 10 + v END) % 97) = 1"""
_SSN = "left(m, 3) NOT IN ('000', '666') AND left(m, 1) <> '9' AND m[5:6] <> '00' AND m[8:11] <> '0000'"
_SCORE = f"regexp_matches(lower(right(gap, {CONTEXT})), '{SPEAKING['ssn']}')"
#: DuckDB's patterns have no look-behind; the added kinds are bounded by \b and checked below.
ORACLE_OP3 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS body FROM documents),
spans AS (
  {_duck_kind(0, KINDS[0], r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 'true')}
  UNION ALL {_duck_kind(1, KINDS[1], r'[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', _SMALL)}
  UNION ALL {_duck_kind(2, KINDS[2], r'[0-9](?:[\x20-]?[0-9])+', _LUHN)}
  UNION ALL {_duck_kind(3, KINDS[3], r'\+[0-9][\x20().0-9-]+[0-9]', f'length({_DIGITS}) BETWEEN 9 AND 15')}
  UNION ALL {_duck_kind(4, KINDS[4], r'\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b', _MOD97)}
  UNION ALL {_duck_kind(5, KINDS[5], r'\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', _SSN + ' AND ' + _SCORE)}
), per AS (
  SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS)},
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (base) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY rid)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)
"""
