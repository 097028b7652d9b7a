"""Values as SQL literals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def _escaped(c: Column) -> Column:
    """Backslashes and line ends escaped, so that a literal stays on one line."""
    for raw, safe in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def sql_text(c: Column, parity: bool = False) -> Column:
    """Quoted text with quotes doubled; ``parity`` leaves all else unescaped."""
    if not parity:
        c = _escaped(c)
    return _quoted(F.replace(c, F.lit("'"), F.lit("''")))


def sql_json(c: Column, parity: bool = False) -> Column:
    """Quoted JSON text with ``"`` as ``\\"``; ``parity`` leaves all else unescaped."""
    if not parity:
        c = F.replace(_escaped(c), F.lit("'"), F.lit("''"))
    return _quoted(F.replace(c, F.lit('"'), F.lit('\\"')))


def sql_float(c: Column, lossless: bool = False) -> Column:
    """Six fixed decimals, or the shortest exact text with ``lossless``.

    Decimals are rounded from the exact binary value, ties to even, for every finite double.
    NaN and infinities have no literal: the query fails.
    """
    x = c.cast("double")
    a = F.abs(x)
    if lossless:
        return F.when(F.isnan(x) | (a == float("inf")), _no_float(x)).otherwise(c.cast("string"))
    # Where a * 1e6 is clearly nearest to n, or n / 1e6 is read as this very double, n is right.
    p = a * 1e6
    n = F.rint(p)
    near = (a < 2.0**32) & ((n / 1e6 == a) | ((a < 1e6) & (F.abs(F.abs(p - n) - 0.5) > 1e-3)))
    whole = n.cast("bigint")
    units = F.call_function("div", whole, F.lit(1_000_000))
    plain = F.concat(_sign(x), units.cast("string"), F.lit("."), F.substring((whole % 1_000_000 + 1_000_000).cast("string"), 2, 6))
    # A lambda is evaluated apart from the generated code, which stays small enough to be compiled;
    # as SQL text it is parsed at once, where building it would take a call per operator.
    exact = F.get(F.call_function("transform", F.array(x), F.expr(f"x -> {EXACT_FLOAT}")), 0)
    return F.when(near, plain).when(x.isNotNull(), F.concat(_sign(x), exact))


def _no_float(x: Column) -> Column:
    return F.raise_error(F.concat(F.lit("no SQL literal for "), x.cast("string"))).cast("string")


def _sign(x: Column) -> Column:
    return F.when((x < 0) | ((x == 0) & (x.cast("string") == "-0.0")), "-").otherwise("")


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for a value that is worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


_SIX = "substring(cast(n % 1000000 + 1000000 as string), 2, 6)"
#: Six decimals of a below 2 ** 53, whose whole part and fraction are exact. The fraction times
#: 2 ** 40 is i + r; i * 1e6 is whole and r * 1e6 exact where it matters, so ``over`` has the right sign.
_ROUNDED = _let(
    "f",
    "a - cast(a as bigint)",
    _let(
        "i",
        f"cast(f * {2.0**40}D as bigint)",
        _let(
            "k",
            "shiftright(i * 1000000, 40)",
            _let(
                "over",
                f"((i * 1000000) & {(1 << 40) - 1}L) - {1 << 39}L + (f * {2.0**40}D - i) * 1e6D",
                _let(
                    "n",
                    "k + if(over > 0 or (over = 0 and k % 2 = 1), 1L, 0L)",
                    f"concat(cast(cast(a as bigint) + n div 1000000 as string), '.', {_SIX})",
                ),
            ),
        ),
    ),
)
#: Digits of a whole number from 2 ** 53 to below 2 ** 124, in two halves of 62 bits.
_LONG_DIGITS = _let(
    "high",
    f"floor(a / {2.0**62}D)",
    f"cast(cast(cast(high as decimal(19,0)) * {1 << 62}BD + cast(a - high * {2.0**62}D as bigint) as decimal(38,0)) as string)",
)
#: Digits of a number from 2 ** 124 on: m * 2 ** e, where m lies between 2 ** 59 and 2 ** 62 and is
#: whole as a has 53 bits, multiplied by up to 2 ** 30 at a time in blocks of nine digits.
_TIMES = """aggregate(blocks, named_struct('carry', 0L, 'out', cast(array() as array<bigint>)),
  (acc, b) -> named_struct('carry', (b * factor + acc.carry) div 1000000000, 'out', concat(acc.out, array((b * factor + acc.carry) % 1000000000))),
  acc -> concat(acc.out, array(acc.carry)))"""
_ALL_DIGITS = _let(
    "e",
    "cast(floor(log2(a)) as int) - 60",
    _let(
        "m",
        "cast(a / pow(2D, e) as bigint)",
        f"""regexp_replace(array_join(transform(reverse(aggregate(
          transform(sequence(0, cast(e div 30 as int)), j -> cast(pow(2D, least(e - j * 30, 30)) as bigint)),
          array(m % 1000000000, (m div 1000000000) % 1000000000, m div 1000000000000000000),
          (blocks, factor) -> {_TIMES})), d -> lpad(cast(d as string), 9, '0')), ''), '^0+', '')""",
    ),
)
#: Text without sign of the double x.
EXACT_FLOAT = _let(
    "a",
    "abs(x)",
    f"""case when isnan(a) or a = double('Infinity') then cast(raise_error(concat('no SQL literal for ', cast(x as string))) as string)
      when a < {2.0**53}D then {_ROUNDED}
      when a < {2.0**124}D then concat({_LONG_DIGITS}, '.000000')
      else concat({_ALL_DIGITS}, '.000000') end""",
)


def sql_bit(c: Column) -> Column:
    return F.when(c.isNotNull(), F.when(c, F.lit("b'1'")).otherwise("b'0'"))


def sql_bool(c: Column) -> Column:
    return F.when(c.isNotNull(), F.when(c, F.lit("true")).otherwise("false"))


def rtrim_nul(c: Column) -> Column:
    """Upper-case hex of binary content without its trailing NUL bytes.

    A hex string has even length, so pairs matched from its end are bytes.
    """
    return F.regexp_replace(F.hex(c), "(00)+$", "")


def sql_binary(c: Column, fixed: bool = False) -> Column:
    """Hex literal; ``fixed`` drops the NUL padding of fixed-width columns."""
    return F.concat(F.lit("x'"), rtrim_nul(c) if fixed else F.hex(c), F.lit("'"))
