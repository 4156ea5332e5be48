"""Scalar semantics on pairs of numbers from ``part``: a in -25..24, b in -4..4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.types import F32, F64, I8, I16, I32, U8, U16, U32
from ..sources import grids

QUERIES: dict[str, tuple] = {}
_P = "p AS (SELECT p_partkey AS k, CAST(p_size - 26 AS BIGINT) AS a, CAST(p_partkey % 9 - 4 AS BIGINT) AS b, CAST(p_partkey * 37 % 256 AS BIGINT) AS u, CAST(p_partkey * 101 % 256 AS BIGINT) AS w, p_retailprice AS f FROM part)"


def _pairs(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    return grids.read(spark, d, "part").select(k.alias("k"), (size - 26).cast("int").alias("a"), (k % 9 - 4).cast("int").alias("b"), (k * 37 % 256).cast("smallint").alias("u"), (k * 101 % 256).cast("smallint").alias("w"), F.col("p_retailprice").alias("f"))


A, B, U, W, FL = E.col("a", I32), E.col("b", I32), E.col("u", U8), E.col("w", U8), E.col("f", F64)


def _put(name: str, exprs: dict, sql: dict, digits: int | None = None) -> None:
    def run(spark, d):
        cols = []
        for k, e in exprs.items():
            c = e.column()
            cols.append((F.round(c.cast("double"), digits) if e.type.is_float and digits is not None else c if e.type.is_bool else c.cast("double" if e.type.is_float else "bigint")).alias(k))
        return _pairs(spark, d).select("k", *cols)

    items = ", ".join(f"{s} AS {k}" for k, s in sql.items())
    QUERIES[name] = (run, f"WITH {_P} SELECT k, {items} FROM p")


def _big(s: str) -> str:
    return f"CAST({s} AS BIGINT)"


_MOD = "(CASE WHEN b = 0 THEN 0 ELSE ((a % b) + abs(b)) % abs(b) END)"
_put("ediv_emod", {"q": A / B, "r": A % B}, {"q": _big(f"CASE WHEN b = 0 THEN 0 ELSE (a - {_MOD}) // b END"), "r": _big(_MOD)})
_put(
    "wrap_casts",
    {"i8": E.i8(A * 31), "u8": E.u8(A * 31), "i16": E.i16(A * 4001), "u16": E.u16(A * 4001), "u32": E.u32(A), "i8u": E.i8(U), "sum8": U + W, "mul8": U * W, "dif8": U - W},
    {
        "i8": _big("((a * 31 + 128) % 256 + 256) % 256 - 128"), "u8": _big("((a * 31) % 256 + 256) % 256"), "i16": _big("((a * 4001 + 32768) % 65536 + 65536) % 65536 - 32768"),
        "u16": _big("((a * 4001) % 65536 + 65536) % 65536"), "u32": _big("(a + 4294967296) % 4294967296"), "i8u": _big("(u + 128) % 256 - 128"),
        "sum8": _big("(u + w) % 256"), "mul8": _big("(u * w) % 256"), "dif8": _big("(u - w + 256) % 256"),
    },
)
_put(
    "saturating_casts",
    {"i8": E.i8_sat(A * 31), "u8": E.u8_sat(A * 31), "i16": E.i16_sat(A * 4001), "u16": E.u16_sat(A * 4001), "add": E.saturating_add(U, W), "sub": E.saturating_sub(U, W), "f8": E.u8_sat(FL / 5.0)},
    {
        "i8": _big("greatest(least(a * 31, 127), -128)"), "u8": _big("greatest(least(a * 31, 255), 0)"), "i16": _big("greatest(least(a * 4001, 32767), -32768)"), "u16": _big("greatest(least(a * 4001, 65535), 0)"),
        "add": _big("least(u + w, 255)"), "sub": _big("greatest(u - w, 0)"), "f8": _big("greatest(least(trunc(f / 5), 255), 0)"),
    },
)
_put(
    "fixed_point",
    {
        "wadd": E.widening_add(U, W), "wsub": E.widening_sub(U, W), "wmul": E.widening_mul(U, W), "hadd": E.halving_add(U, W), "rhadd": E.rounding_halving_add(U, W), "hsub": E.halving_sub(U, W),
        "rsr": E.rounding_shift_right(U, 3), "rsl": E.rounding_shift_left(U, 2), "msr": E.mul_shift_right(U, W, 8), "rmsr": E.rounding_mul_shift_right(U, W, 8), "drz": E.div_round_to_zero(A, 7), "mrz": E.mod_round_to_zero(A, 7),
    },
    {
        "wadd": _big("u + w"), "wsub": _big("u - w"), "wmul": _big("u * w"), "hadd": _big("(u + w) // 2"), "rhadd": _big("(u + w + 1) // 2"), "hsub": _big("(CAST(floor((u - w) / 2.0) AS BIGINT) + 256) % 256"),
        "rsr": _big("(u + 4) // 8"), "rsl": _big("least(u * 4, 255)"), "msr": _big("(u * w) // 256"), "rmsr": _big("least((u * w + 128) // 256, 255)"), "drz": _big("a // 7"), "mrz": _big("a % 7"),
    },
)
_put(
    "bit_ops",
    {
        "band": U & W, "bor": U | W, "bxor": U ^ W, "bnot": ~U, "shl": U << 3, "shr": U >> 3, "sar": A >> 2, "shn": U << -2, "pop": E.popcount(U), "clz": E.count_leading_zeros(U), "ctz": E.count_trailing_zeros(U),
        "ext": E.extract_bits(U8, E.cast(U16, U) * 257, 4), "cat": E.concat_bits([U, W]), "popn": E.popcount(E.i8(A)),
    },
    {
        "band": _big("u & w"), "bor": _big("u | w"), "bxor": _big("xor(u, w)"), "bnot": _big("255 - u"), "shl": _big("(u * 8) % 256"), "shr": _big("u // 8"), "sar": _big("CAST(floor(a / 4.0) AS BIGINT)"), "shn": _big("u // 4"),
        "pop": _big("bit_count(u)"), "clz": _big("CASE WHEN u = 0 THEN 8 ELSE 8 - length(bin(u)) END"), "ctz": _big("CASE WHEN u = 0 THEN 8 ELSE bit_count((u & -u) - 1) END"),
        "ext": _big("(u * 257 // 16) % 256"), "cat": _big("u + 256 * w"), "popn": _big("bit_count((a + 256) % 256)"),
    },
)
_put(
    "lerp_u8",
    {"v": E.lerp(U, W, E.u8(A + 100)), "f": E.lerp(E.cast(F64, U), E.cast(F64, W), E.const(0.25, F64))},
    {"v": _big("floor((u * (255 - (a + 100)) + w * (a + 100)) / 255.0 + 0.5)"), "f": "CAST(u * 0.75 + w * 0.25 AS DOUBLE)"},
)
_X = E.cast(F64, A) / 4.0
_put(
    "rounding",
    {"fl": E.floor(_X), "ce": E.ceil(_X), "ro": E.round_(_X), "tr": E.trunc(_X), "fr": E.fract(_X), "fd": _X / E.cast(F64, B), "nan": E.is_nan(_X / E.cast(F64, B)), "inf": E.is_inf(_X / E.cast(F64, B)), "fin": E.is_finite(_X / E.cast(F64, B)), "fm": E.cast(F64, A) % 3.0},
    {
        "fl": "CAST(floor(a / 4.0) AS DOUBLE)", "ce": "CAST(ceil(a / 4.0) AS DOUBLE)", "ro": "CAST(round_even(a / 4.0, 0) AS DOUBLE)", "tr": "CAST(trunc(a / 4.0) AS DOUBLE)", "fr": "CAST(a / 4.0 - trunc(a / 4.0) AS DOUBLE)",
        "fd": "CASE WHEN b <> 0 THEN (a / 4.0::DOUBLE) / b WHEN a = 0 THEN 'nan'::DOUBLE WHEN a > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END",
        "nan": "a = 0 AND b = 0", "inf": "a <> 0 AND b = 0", "fin": "b <> 0", "fm": "CAST(a - 3 * floor(a / 3.0) AS DOUBLE)",
    },
)
_put(
    "select_mux",
    {
        "sel": E.select(A < 0, A, B > 2, B, 7), "mux": E.mux(B, [E.const(10), E.const(20), E.const(30)]), "cl": E.clamp(A, -10, 12), "ab": E.abs_(A), "ad": E.absd(A, B),
        "mx": E.max_(A, B, 3), "mn": E.min_(A, B, 3), "lt": A < B, "both": E.logical_and(A > 0, B > 0), "either": E.logical_or(A > 20, B == -4), "p3": E.pow_(A, 3),
    },
    {
        "sel": _big("CASE WHEN a < 0 THEN a WHEN b > 2 THEN b ELSE 7 END"), "mux": _big("CASE b WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 30 END"), "cl": _big("greatest(least(a, 12), -10)"), "ab": _big("abs(a)"), "ad": _big("abs(a - b)"),
        "mx": _big("greatest(a, b, 3)"), "mn": _big("least(a, b, 3)"), "lt": "a < b", "both": "a > 0 AND b > 0", "either": "a > 20 OR b = -4", "p3": _big("a * a * a"),
    },
)
_put(
    "coercion",
    {"mix": E.i8(A) + U, "fi": E.cast(F32, A) * U, "lit": U + 5, "cmp": E.i8(B) < U, "w16": E.u16(U) * W},
    {"mix": _big("((a + (u + 128) % 256 - 128 + 128) % 256 + 256) % 256 - 128"), "fi": "CAST(a * u AS DOUBLE)", "lit": _big("(u + 5) % 256"), "cmp": "b < (u + 128) % 256 - 128", "w16": _big("u * w")},
)
_Y = E.cast(F64, A) / 10.0
_put(
    "math_functions",
    {
        "sin": E.sin(_Y), "cos": E.cos(_Y), "tan": E.tan(_Y), "atan": E.atan(_Y), "exp": E.exp(_Y), "log": E.log(E.abs_(_Y) + 1.0), "sqrt": E.sqrt(E.abs_(_Y)), "sinh": E.sinh(_Y), "cosh": E.cosh(_Y), "tanh": E.tanh(_Y),
        "asin": E.asin(_Y / 3.0), "acos": E.acos(_Y / 3.0), "asinh": E.asinh(_Y), "acosh": E.acosh(E.abs_(_Y) + 1.0), "atanh": E.atanh(_Y / 3.0), "atan2": E.atan2(_Y, _Y + 7.0), "hyp": E.hypot(_Y, _Y + 1.0), "pw": E.pow_(E.abs_(_Y) + 1.0, E.const(1.5, F64)),
    },
    {
        k: f"round({s}, 9)"
        for k, s in {
            "sin": "sin(a / 10.0)", "cos": "cos(a / 10.0)", "tan": "tan(a / 10.0)", "atan": "atan(a / 10.0)", "exp": "exp(a / 10.0)", "log": "ln(abs(a / 10.0) + 1)", "sqrt": "sqrt(abs(a / 10.0))", "sinh": "sinh(a / 10.0)", "cosh": "cosh(a / 10.0)", "tanh": "tanh(a / 10.0)",
            "asin": "asin(a / 30.0)", "acos": "acos(a / 30.0)", "asinh": "asinh(a / 10.0)", "acosh": "acosh(abs(a / 10.0) + 1)", "atanh": "atanh(a / 30.0)", "atan2": "atan2(a / 10.0, a / 10.0 + 7)", "hyp": "sqrt((a / 10.0) * (a / 10.0) + (a / 10.0 + 1) * (a / 10.0 + 1))", "pw": "pow(abs(a / 10.0) + 1, 1.5)",
        }.items()
    },
    9,
)


_put(
    "comparisons",
    {"le": A <= B, "gt": A > B, "ge": A >= B, "ne": A != B, "eq": A == B, "no": E.logical_not(A < B), "inv": ~(A < 0), "neg": -A, "negu": -U, "both": E.logical_and(A <= 3, B != 0, A > -9)},
    {"le": "a <= b", "gt": "a > b", "ge": "a >= b", "ne": "a <> b", "eq": "a = b", "no": "NOT a < b", "inv": "NOT a < 0", "neg": _big("-a"), "negu": _big("(256 - u) % 256"), "both": "a <= 3 AND b <> 0 AND a > -9"},
)


def _in_place() -> dict:
    """The left side's type stays, whatever the right side's is."""
    plus, minus, times, over = U, U, U, U
    plus += A
    minus -= A
    times *= A
    over /= W | 1
    return {"plus": plus, "minus": minus, "times": times, "over": over}


_put("in_place_operators", _in_place(), {"plus": _big("((u + a) % 256 + 256) % 256"), "minus": _big("((u - a) % 256 + 256) % 256"), "times": _big("(u * ((a + 256) % 256)) % 256"), "over": _big("u // (w | 1)")})
_T0, _T1 = E.select(A < 0, (A, U), (B, W)), E.select((A < 0, A > 5), (A, U), (B, W))
_M0, _M1 = E.mux(B, [(A, U), (A + 1, W), (B, U)])
_put(
    "tuple_selects",
    {"s0": _T0[0], "s1": _T0[1], "c0": _T1[0], "c1": _T1[1], "m0": _M0, "m1": _M1},
    {"s0": _big("CASE WHEN a < 0 THEN a ELSE b END"), "s1": _big("CASE WHEN a < 0 THEN u ELSE w END"), "c0": _big("CASE WHEN a < 0 THEN a ELSE b END"), "c1": _big("CASE WHEN a > 5 THEN u ELSE w END"), "m0": _big("CASE b WHEN 0 THEN a WHEN 1 THEN a + 1 ELSE b END"), "m1": _big("CASE b WHEN 0 THEN u WHEN 1 THEN w ELSE u END")},
)
_U16, _I8 = E.u16(U), E.i8(A)
_put(
    "widening_ops",
    {
        "ra": E.widen_right_add(_U16, W), "rs": E.widen_right_sub(_U16, W), "rm": E.widen_right_mul(_U16, W), "wl": E.widening_shift_left(U, 3), "wr": E.widening_shift_right(U, 2),
        "rei": E.reinterpret(I8, U), "reu": E.reinterpret(U32, A), "ll": E.lossless_cast(I16, U), "lm": E.lossless_cast(U8, A & 127), "fd": E.fast_integer_divide(U, W | 1), "fm": E.fast_integer_modulo(U, W | 1),
    },
    {
        "ra": _big("u + w"), "rs": _big("(u - w + 65536) % 65536"), "rm": _big("u * w"), "wl": _big("u * 8"), "wr": _big("u // 4"), "rei": _big("(u + 128) % 256 - 128"), "reu": _big("(a + 4294967296) % 4294967296"),
        "ll": _big("u"), "lm": _big("((a % 128) + 128) % 128"), "fd": _big("u // (w | 1)"), "fm": _big("u % (w | 1)"),
    },
)
_ERF = "(sign({x}) * (1 - {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({x}) * ({x}))))"
_put(
    "fast_math",
    {
        "fma": E.fma(_Y, E.cast(F64, B), _Y + 1.0), "erf": E.erf(_Y), "fs": E.fast_sin(_Y), "fc": E.fast_cos(_Y), "fe": E.fast_exp(_Y), "fl": E.fast_log(E.abs_(_Y) + 1.0), "fp": E.fast_pow(E.abs_(_Y) + 1.0, E.const(0.5, F64)),
        "fi": E.fast_inverse(_Y + 3.05), "fq": E.fast_inverse_sqrt(E.abs_(_Y) + 1.0), "pi": E.pow_(_Y + 3.05, -2),
    },
    {
        k: f"round({v}, 6)"
        for k, v in {
            "fma": "a / 10.0 * b + a / 10.0 + 1", "erf": _ERF.format(x="a / 10.0", t="(1 / (1 + 0.3275911 * abs(a / 10.0)))"), "fs": "sin(a / 10.0)", "fc": "cos(a / 10.0)", "fe": "exp(a / 10.0)", "fl": "ln(abs(a / 10.0) + 1)", "fp": "sqrt(abs(a / 10.0) + 1)",
            "fi": "1 / (a / 10.0 + 3.05)", "fq": "1 / sqrt(abs(a / 10.0) + 1)", "pi": "1 / ((a / 10.0 + 3.05) * (a / 10.0 + 3.05))",
        }.items()
    },
    6,
)
_put(
    "checks_and_hints",
    {
        "req": E.require(A < 100, A), "lik": E.likely(A), "lii": E.likely_if_innermost(A), "pro": E.promise_clamped(A, -25, 25), "upc": E.unsafe_promise_clamped(A, -25, 25), "mem": E.memoize_tag(A, B), "pri": E.print_(A, "a"), "prw": E.print_when(A > 3, A, "a"),
        "str": E.strict_float(_Y), "unr": E.select(A < 100, A, E.unreachable()), "bits": E.const(E.target_bits()), "feat": E.select(E.const(E.target_has_feature("any") or E.target_arch_is("any") or E.target_os_is("any")), 1, 0), "vec": E.const(E.target_natural_vector_size(I32)),
    },
    {**{k: _big("a") for k in ("req", "lik", "lii", "pro", "upc", "mem", "pri", "prw", "unr")}, "str": "round(a / 10.0, 9)", "bits": _big("64"), "feat": _big("0"), "vec": _big("1")},
    9,
)


def _rng(x: str) -> str:
    c0, c1, c2 = E.RNG_COEFFICIENTS
    return f"CAST((((({c2}::HUGEINT * {x} + {c1}) % 4294967296) * {x} + {c0}) % 4294967296) AS BIGINT)"


QUERIES["random_hash"] = (
    lambda spark, d: _pairs(spark, d).select("k", E.random_uint([E.col("k", U32)], 5).column().alias("u"), E.random_int([E.col("k", U32)], 5).column().alias("i"), F.round(E.random_float([E.col("k", U32)], 5).column().cast("double"), 7).alias("f")),
    f"WITH {_P}, r0 AS (SELECT k, {_rng('5')} AS r FROM p), r1 AS (SELECT k, {_rng('((r + k) % 4294967296)')} AS r FROM r0), r2 AS (SELECT k, {_rng('r')} AS r FROM r1) SELECT k, CAST(xor(r, r // 65536) AS BIGINT) AS u, CAST((xor(r, r // 65536) + 2147483648) % 4294967296 - 2147483648 AS INT) AS i, round(CAST(xor(r, r // 65536) // 512 AS DOUBLE) / 8388608, 7) AS f FROM r2",
)
