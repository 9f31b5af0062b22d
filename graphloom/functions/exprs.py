"""Column expressions that stay inside the JVM: integer mixing and vector distances."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 0xFFFFFFFF

# The two integer mixes, one (constant, operation, shift, join) a step.
MIX32 = [
    (0x7ED55D16, "+", 12, "+", "<"), (0xC761C23C, "^", 19, "^", ">"), (0x165667B1, "+", 5, "+", "<"),
    (0xD3A2646C, "+", 9, "^", "<"), (0xFD7046C5, "+", 3, "+", "<"), (0xB55A4F09, "^", 16, "^", ">"),
]
MIX64 = [
    (0x7ED55D166BEF7A1D, "+", 12, "+", "<"), (0xC761C23C510FA2DD, "^", 9, "^", ">"), (0x165667B183A9C0E1, "+", 59, "+", "<"),
    (0xD3A2646CAB3487E3, "+", 49, "^", "<"), (0xFD7046C5EF9AB54C, "+", 3, "+", "<"), (0xB55A4F090DD4A67B, "^", 32, "^", ">"),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def add64(a: Column, b: Column) -> Column:
    """Sum modulo 2**64 (plain addition raises on overflow in ANSI mode)."""
    low = a.bitwiseAND(F.lit(U32)) + b.bitwiseAND(F.lit(U32))
    return let(low, lambda s: F.shiftleft(F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(s, 32), 32).bitwiseOR(s.bitwiseAND(F.lit(U32))))


def hash32(value: Column) -> Column:
    """32-bit integer mix of a value in [0, 2**32), as a long in the same range."""
    x = value.cast("long")
    for constant, op, shift, join, way in MIX32:

        def step(a, constant=constant, op=op, shift=shift, join=join, way=way):
            left = (a + F.lit(constant)) if op == "+" else a.bitwiseXOR(F.lit(constant).cast("long"))
            right = F.shiftleft(a, shift) if way == "<" else F.shiftrightunsigned(a, shift)
            return (left + right if join == "+" else left.bitwiseXOR(right)).bitwiseAND(F.lit(U32))

        x = _apply(x, step)
    return x


def _apply(x: Column, step) -> Column:
    return let(x, lambda a: step(a))


def hash64(value: Column) -> Column:
    """64-bit integer mix; the bits of the unsigned result as a signed long."""
    x = value.cast("long")
    for constant, op, shift, join, way in MIX64:

        def step(a, constant=constant, op=op, shift=shift, join=join, way=way):
            c = F.lit(_signed(constant))
            left = add64(a, c) if op == "+" else a.bitwiseXOR(c)
            right = F.shiftleft(a, shift) if way == "<" else F.shiftrightunsigned(a, shift)
            return add64(left, right) if join == "+" else left.bitwiseXOR(right)

        x = _apply(x, step)
    return x


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) that the columns fix: for our own random choices."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11) + 0.5) / float(1 << 53)


def umod(value: Column, n: int) -> Column:
    """Remainder of the unsigned 64-bit value by ``n`` < 2**61."""
    return ((F.shiftrightunsigned(value, 1) % n) * 2 + value.bitwiseAND(F.lit(1))) % n


def hash32_int(a: int) -> int:
    """``hash32`` of a Python integer."""
    for constant, op, shift, join, way in MIX32:
        left = a + constant if op == "+" else a ^ constant
        right = a << shift if way == "<" else a >> shift
        a = (left + right if join == "+" else (left & U32) ^ right) & U32
    return a


def hash64_int(a: int) -> int:
    """``hash64`` of a Python integer, unsigned."""
    m = (1 << 64) - 1
    for constant, op, shift, join, way in MIX64:
        left = (a + constant) & m if op == "+" else a ^ constant
        right = (a << shift) & m if way == "<" else a >> shift
        a = (left + right) & m if join == "+" else left ^ right
    return a


def hash32_array(values: np.ndarray) -> np.ndarray:
    """``hash32`` of the low 32 bits of integers."""
    u32, a = np.uint64(U32), values.astype(np.uint64) & np.uint64(U32)
    for constant, op, shift, join, way in MIX32:
        left = a + np.uint64(constant) if op == "+" else a ^ np.uint64(constant)
        right = a << np.uint64(shift) if way == "<" else a >> np.uint64(shift)
        a = (left + right if join == "+" else left ^ right) & u32
    return a


def hash64_array(values: np.ndarray) -> np.ndarray:
    """``hash64`` of integers, unsigned."""
    a = values.astype(np.uint64)
    for constant, op, shift, join, way in MIX64:
        left = a + np.uint64(constant) if op == "+" else a ^ np.uint64(constant)
        right = a << np.uint64(shift) if way == "<" else a >> np.uint64(shift)
        a = left + right if join == "+" else left ^ right
    return a


def _fold(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def l1(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double"))))


def mismatches(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (x != y).cast("double")))
