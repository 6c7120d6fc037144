"""Universal integer codes as strings of 0 and 1: unary, Elias gamma, Fibonacci.

Defined for 1 <= n < 2^63 (unary, as long as its code: up to 2^31 - 1); others give
null.  All are JVM expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def fibonacci_numbers(most: int = 1 << 62) -> list[int]:
    """1, 2, 3, 5, ... up to `most`."""
    out, a, b = [], 1, 2
    while a <= most:
        out.append(a)
        a, b = b, a + b
    return out


def _valid(n: Column, code: Column) -> Column:
    return F.when(n >= 1, code)


def unary(n: Column) -> Column:
    return F.when((n >= 1) & (n < 1 << 31), F.concat(F.repeat(F.lit("1"), F.least(n - 1, F.lit((1 << 31) - 2)).cast("int")), F.lit("0")))


def gamma(n: Column) -> Column:
    """The unary code of the length in bits, then the bits below the highest."""
    bits = F.bin(n)
    size = F.length(bits)
    return _valid(n, F.concat(F.repeat(F.lit("1"), size - 1), F.lit("0"), F.substring(bits, F.lit(2), size)))


def fibonacci(n: Column) -> Column:
    """The Zeckendorf digits, lowest first, and a closing 1."""
    table = F.array(*[F.lit(x) for x in reversed(fibonacci_numbers((1 << 63) - 1))])
    start = F.struct(n.cast("long").alias("rest"), F.lit("").alias("bits"))
    step = lambda s, f: F.struct(F.when(s["rest"] >= f, s["rest"] - f).otherwise(s["rest"]).alias("rest"), F.concat(F.when(s["rest"] >= f, "1").when(s["bits"] != "", "0").otherwise(""), s["bits"]).alias("bits"))
    return _valid(n, F.aggregate(table, start, step, lambda s: F.concat(s["bits"], F.lit("1"))))


def gamma_length(n: Column) -> Column:
    """Bits of the gamma code, without the code."""
    return _valid(n, 2 * F.length(F.bin(n)) - 1)


def fibonacci_length(n: Column) -> Column:
    """Bits of the Fibonacci code: one more than the numbers of the sequence up to n.
    Their count is near a logarithm; the sequence itself says whether it is one off."""
    numbers = fibonacci_numbers((1 << 63) - 1)
    table = F.array(*[F.lit(x) for x in numbers])
    guess = F.floor(F.log((n.cast("double") + 0.5) * math.sqrt(5)) / math.log((1 + math.sqrt(5)) / 2)).cast("int") - 1
    more = F.when(F.get(table, guess) <= n, 1).otherwise(0)
    less = F.when(F.get(table, guess - 1) > n, 1).otherwise(0)
    return _valid(n, guess + more - less + 1)


ENCODERS = {"unary": unary, "gamma": gamma, "fibonacci": fibonacci}


def decode_unary(bits: Column) -> Column:
    """All numbers of a stream of unary codes."""
    parts = F.split(bits, "0", -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: (F.length(x) + 1).cast("long"))


def decode_fibonacci(bits: Column) -> Column:
    """All numbers of a stream of Fibonacci codes (each ends at its first 11)."""
    values = F.array(*[F.lit(x) for x in fibonacci_numbers((1 << 63) - 1)])
    words = F.regexp_extract_all(bits, F.lit("0*(?:10+)*11"), F.lit(0))
    number = lambda w: F.aggregate(F.sequence(F.lit(1), F.length(w) - 1), F.lit(0).cast("long"), lambda a, i: a + F.when(F.substring(w, i, F.lit(1)) == "1", F.get(values, i - 1)).otherwise(F.lit(0).cast("long")))
    return F.transform(words, lambda w: number(w))


def decode_gamma(bits: Column) -> Column:
    """All numbers of a stream of gamma codes, one after another: a code's length
    says where the next starts."""
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<bigint>").alias("got"))

    def read(s, _):
        ones = F.instr(F.substring(bits, s["at"], F.length(bits)), "0") - 1
        low = F.substring(bits, s["at"] + ones + 1, ones)
        number = F.conv(F.concat(F.lit("1"), low), 2, 10).cast("long")
        more = F.struct((s["at"] + 2 * ones + 1).alias("at"), F.concat(s["got"], F.array(number)).alias("got"))
        return F.when((s["at"] <= F.length(bits)) & (ones >= 0), more).otherwise(s)

    # A code has one zero at its unary end, so there are no more codes than zeros.
    zeros = F.length(bits) - F.length(F.replace(bits, F.lit("0")))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(zeros, F.lit(1))), state, read, lambda s: s["got"])


def gaps(ids: Column) -> Column:
    """The first id and then the differences, of an ascending array."""
    return F.transform(ids, lambda x, i: x - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(ids, i - 1)))


def encode_list(numbers: Column, code: str) -> Column:
    return F.array_join(F.transform(numbers, lambda n: ENCODERS[code](n)), "")
