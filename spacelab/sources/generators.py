"""The registry of generators.

A generator is described once.  Counter and affine generators have a column form, so their orbits are built-in
expressions over ``range``; the others are stepped in vectorised lanes by an Arrow function, each lane starting from a
state that was jumped to, or, where a generator cannot jump, found by one sequential walk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bits import MASK64, ArrayOps, ColumnOps, IntOps, multiply, signed

State = tuple[int, ...]


class UnknownGenerator(ValueError):
    """No generator of this name is registered."""


@dataclass(frozen=True)
class Generator:
    """Outputs are 64 bits; narrower words are left-justified.

    start(seed) -> state; step(state) -> (output, state); jump(state, n) -> state after n steps, or None if there is no
    way but stepping.  ``column(ops, seed, n)`` is draw n (from 0) as an expression; ``block(seed, first, count)`` is
    a run of draws as uint64.  ``lanes(states)`` steps a matrix of states (one row a lane, uint64) once and returns the
    outputs; it changes the states in place.
    """

    name: str
    start: Callable[[int], State]
    step: Callable[[State], tuple[int, State]]
    jump: Callable[[State, int], State] | None = None
    column: Callable[[ColumnOps, int, Column], Column] | None = None
    lanes: Callable[[np.ndarray], np.ndarray] | None = None
    block: Callable[[int, int, int], np.ndarray] | None = None
    words: int = 1  # 64-bit words that hold a state for ``lanes``
    title: str = ""

    def outputs(self, seed: int, count: int, skip: int = 0) -> list[int]:
        """Draws skip .. skip + count - 1, one by one."""
        state, out = self.at(seed, skip), []
        for _ in range(count):
            value, state = self.step(state)
            out.append(value)
        return out

    def at(self, seed: int, draws: int) -> State:
        """State after that many draws."""
        state = self.start(seed & MASK64)
        if self.jump:
            return self.jump(state, draws)
        for _ in range(draws):
            state = self.step(state)[1]
        return state

    def pack(self, state: State) -> list[int]:
        """The state as ``words`` 64-bit words."""
        return list(state)


_registry: dict[str, Generator] = {}


def register_generator(generator: Generator) -> Generator:
    """Make a generator known by its name; the last registration of a name counts."""
    _registry[generator.name] = generator
    return generator


def generator(name: str) -> Generator:
    if name not in _registry:
        raise UnknownGenerator(f"unknown generator {name!r}; there are {', '.join(sorted(_registry))}")
    return _registry[name]


def generator_names() -> list[str]:
    return sorted(_registry)


# ----- counters: the state is seed + n * increment, the output a mix of it -----

#: Increments and multipliers.
PHI = 0x9E3779B97F4A7C15
WY_ADD, WY_XOR = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
WY4_ADD, WY4_XOR = 0x2D358DCCAA6C78A5, 0x8BB84B93962EACC9


def _counter(name: str, title: str, increment: int, mix: Callable[[Any, Any, Any], Any]) -> None:
    """mix(ops, x, following): output from the state before the draw and the one after it."""
    ops = IntOps()

    def step(state: State) -> tuple[int, State]:
        after = (state[0] + increment) & MASK64
        return mix(ops, state[0], after), (after,)

    def column(ops: ColumnOps, seed: int, n: Column) -> Column:
        x = ops.let(n * ops.const(increment) + ops.const(seed))
        return mix(ops, x, ops.let(x + ops.const(increment)))

    register_generator(Generator(
        name, lambda seed: (seed & MASK64,), step, lambda state, n: ((state[0] + n * increment) & MASK64,), column, block=_block_of(column), title=title))


def _block_of(column: Callable[[Any, int, Any], Any]) -> Callable[[int, int, int], np.ndarray]:
    """The column form over a run of draw numbers."""
    return lambda seed, first, count: column(ArrayOps(), seed, np.arange(first, first + count, dtype=np.uint64))


def _fold(o, a, b):
    """Both halves of the product, xored."""
    a, b = o.let(a), o.let(b)
    return o.xor(o.mulhi(a, b), o.mul(a, b))


def _splitmix(o, x, following):
    z = o.let(o.mul(o.xor(x, o.shr(x, 30)), o.const(0xBF58476D1CE4E5B9)))
    z = o.let(o.mul(o.xor(z, o.shr(z, 27)), o.const(0x94D049BB133111EB)))
    return o.xor(z, o.shr(z, 31))


def _middle_square(o, x, following):
    y = o.let(o.mul(following, o.const(PHI)))
    z = o.let(o.add(y, o.const(PHI)))
    v = y
    for plus in (y, z, y):
        v = o.let(o.add(o.mul(v, v), plus))
        v = o.let(o.rotl(v, 32))
    kept = o.let(o.add(o.mul(v, v), z))
    v = o.let(o.rotl(kept, 32))
    return o.xor(kept, o.shr(o.let(o.add(o.mul(v, v), y)), 32))


_counter("splitmix", "SplitMix", PHI, _splitmix)
_counter("incr", "incr (counter, x += 1)", 1, lambda o, x, following: following)
_counter("wyrand", "wyrand", WY_ADD, lambda o, x, following: _fold(o, o.xor(x, o.const(WY_XOR)), x))
_counter("wyrand-next", "wyrand (second factor from the state after the draw)", WY_ADD, lambda o, x, following: _fold(o, o.xor(x, o.const(WY_XOR)), following))
_counter("wyrand-v4", "wyrand (wyhash v4)", WY4_ADD, lambda o, x, following: _fold(o, following, o.xor(following, o.const(WY4_XOR))))
_counter("MSWS-CTR", "MSWS-CTR (middle-square Weyl sequence, counter-based)", 1, _middle_square)

_WIDE, _WIDE_MASK = (WY4_ADD << 64) | WY4_XOR, (1 << 128) - 1


def _wide_output(o, high, low):
    return _fold(o, low, o.xor(high, low))


def _wide_step(state: State) -> tuple[int, State]:
    after = (state[0] + _WIDE) & _WIDE_MASK
    return _wide_output(IntOps(), after >> 64, after & MASK64), (after,)


def _wide_column(o: ColumnOps, seed: int, n: Column) -> Column:
    """The 128-bit counter in two words: seed + (n + 1) * (add_high : add_low), with the carry of the low word."""
    count = o.let(n + o.const(1))
    product = o.let(count * o.const(WY4_XOR))
    low = o.let(product + o.const(seed))
    carry = o.less(low, product)
    high = o.let(o.mulhi(count, o.const(WY4_XOR)) + count * o.const(WY4_ADD) + carry)
    return _wide_output(o, high, low)


register_generator(Generator(
    "wyrand128", lambda seed: (seed & MASK64,), _wide_step, lambda state, n: ((state[0] + n * _WIDE) & _WIDE_MASK,), _wide_column,
    block=_block_of(_wide_column), title="wyrand128"))


# ----- affine: x <- a x + 1, the output is the new state -----


def affine_power(multiplier: int, n: int, bits: int) -> tuple[int, int]:
    """(m, c) with m x + c = n applications of x -> multiplier x + 1, modulo 2^bits."""
    size = 1 << bits
    # the sum of the first n powers is (multiplier^n - 1) / (multiplier - 1); the modulus is widened by the divisor
    wide = size * (multiplier - 1)
    return pow(multiplier, n, size), ((pow(multiplier, n, wide) - 1) % wide) // (multiplier - 1) % size


def _affine(name: str, title: str, multiplier: int, bits: int) -> None:
    mask, left = (1 << bits) - 1, 64 - bits

    def step(state: State) -> tuple[int, State]:
        x = (multiplier * state[0] + 1) & mask
        return x << left, (x,)

    def jump(state: State, n: int) -> State:
        m, c = affine_power(multiplier, n, bits)
        return ((m * state[0] + c) & mask,)

    def column(o: ColumnOps, seed: int, n: Column) -> Column:
        """n + 1 steps, four bits of the count at a time: the steps that one such digit stands for are one of 16 maps."""
        count, x = o.let(n + 1), o.const(seed & mask)
        for digit in range(12):  # counts below 2^48
            maps = [affine_power(multiplier, k << (4 * digit), bits) for k in range(16)]
            at = o.let(F.shiftrightunsigned(count, 4 * digit).bitwiseAND(15).cast("int") + 1)
            m, c = (F.element_at(F.expr(f"array({', '.join(f'{signed(p[i])}L' for p in maps)})"), at) for i in (0, 1))
            x = o.let(m * x + c)
        return F.shiftleft(x, left) if left else x

    held: list[np.ndarray] = []  # powers of the map, the same for every run

    def block(seed: int, first: int, count: int) -> np.ndarray:
        """Powers of the map by doubling, applied to the state before the run."""
        if not held or len(held[0]) < count:
            m, c = np.array([multiplier], np.uint64), np.array([1], np.uint64)
            while len(m) < count:  # the next half of the powers is the last one applied after the first half
                m, c = np.r_[m, m * m[-1]], np.r_[c, c * m[-1] + c[-1]]
            held[:] = m, c
        m, c = held
        x = (m[:count] * np.uint64(jump((seed & mask,), first)[0]) + c[:count]) & np.uint64(mask)
        return x << np.uint64(left) if left else x

    register_generator(Generator(name, lambda seed: (seed & mask,), step, jump, column, block=block, title=title))


#: Multipliers and word sizes.
_affine("lcg_64_64_0xa5b9ee81534fa94d", "LCG64 (0xa5b9ee81534fa94d)", 0xA5B9EE81534FA94D, 64)
_affine("lcg_32_32_0xec65035", "LCG32 (0xec65035)", 0xEC65035, 32)
_affine("lcg_32_32_0x915f77f5", "LCG32 (0x915f77f5)", 0x915F77F5, 32)


# ----- multiply-with-carry -----

class _Mwc(Generator):
    """The state is one number: words from the oldest up, the carry on top.  A step multiplies it by the inverse of
    2^bits modulo multiplier * 2^(bits lag) - 1, and the output is the newest word."""


def _mwc(name: str, title: str, multiplier: int, bits: int, lag: int, first: Callable[[int], list[int]]) -> None:
    base = 1 << bits
    top = base ** (lag - 1)
    modulus = multiplier * base**lag - 1
    inverse = multiplier * top % modulus
    left = 64 - bits

    def start(seed: int) -> State:
        return (sum(w << (bits * i) for i, w in enumerate(first(seed))) + base**lag,)

    def step(state: State) -> tuple[int, State]:
        s = state[0]
        newest = (s >> (bits * (lag - 1))) & (base - 1)
        return newest << left, ((s >> bits) + multiplier * top * (s & (base - 1)),)

    def jump(state: State, n: int) -> State:
        return (state[0] * pow(inverse, n, modulus) % modulus,) if n else state

    def pack(state: State) -> list[int]:
        return [(state[0] >> (bits * i)) & (base - 1) for i in range(lag)] + [state[0] >> (bits * lag)]

    def lanes(states: np.ndarray) -> np.ndarray:
        out = states[:, lag - 1].copy()
        if bits == 64:
            high, low = multiply(np.uint64(multiplier), states[:, 0])
            word = low + states[:, lag]
            carry = high + (word < low)
        else:
            product = states[:, 0] * np.uint64(multiplier) + states[:, lag]
            carry, word = product >> np.uint64(bits), product & np.uint64(base - 1)
        states[:, : lag - 1] = states[:, 1:lag]
        states[:, lag - 1], states[:, lag] = word, carry
        return out << np.uint64(left) if left else out

    made = _Mwc(name, start, step, jump, lanes=lanes, words=lag + 1, title=title)
    object.__setattr__(made, "pack", pack)
    register_generator(made)


#: Multipliers, word sizes, lags and first words (oldest first).
_mwc("mwc_128_64_0xff96d28c3f3329da", "MWC128 (0xff96d28c3f3329da)", 0xFF96D28C3F3329DA, 64, 1, lambda seed: [seed])
_mwc("mwc_128_64_0xffebb71d94fcdaf9", "MWC128 (0xffebb71d94fcdaf9)", 0xFFEBB71D94FCDAF9, 64, 1, lambda seed: [seed])
_mwc("mwc_192_64_0xffa04e67b3c95d86", "MWC192 (0xffa04e67b3c95d86)", 0xFFA04E67B3C95D86, 64, 2, lambda seed: [seed] * 2)
_mwc("mwc_256_64_0xfff62cf2ccc0cdaf", "MWC256 (0xfff62cf2ccc0cdaf)", 0xFFF62CF2CCC0CDAF, 64, 3, lambda seed: [seed] * 3)
_mwc("mwc_128_32_0xfffea2df", "MWC128-32 (0xfffea2df)", 0xFFFEA2DF, 32, 3, lambda seed: [seed & 0xFFFFFFFF, seed >> 32, 0])


# ----- Romu: multiplications and rotations that nobody can jump over -----


def _rotated(x, n: int, bits: int):
    """Rotation of integers or of uint64 arrays with ``bits`` wide words."""
    if isinstance(x, np.ndarray):
        if bits == 64:
            return (x << np.uint64(n)) | (x >> np.uint64(64 - n))
        return ((x << np.uint64(n)) | (x >> np.uint64(bits - n))) & np.uint64((1 << bits) - 1)
    return ((x << n) | (x >> (bits - n))) & ((1 << bits) - 1)


def _romu(name: str, title: str, first: Callable[[int], State], move: Callable[..., tuple], bits: int = 64) -> None:
    """move(words...) -> words after a step; the output is the first word before it."""
    mask, left = (1 << bits) - 1, 64 - bits

    def step(state: State) -> tuple[int, State]:
        return state[0] << left, tuple(int(w) & mask for w in move(*state))

    def lanes(states: np.ndarray) -> np.ndarray:
        out = states[:, 0].copy()
        for i, w in enumerate(move(*(states[:, i].copy() for i in range(states.shape[1])))):
            states[:, i] = w & np.uint64(mask)
        return out << np.uint64(left) if left else out

    register_generator(Generator(name, first, step, lanes=lanes, words=len(first(1)), title=title))


def _times(k: int, x, bits: int = 64):
    return x * np.uint64(k) if isinstance(x, np.ndarray) else (x * k) & ((1 << bits) - 1)


#: Multipliers and rotations.
ROMU64, ROMU32 = 15241094284759029579, 3323815723


def _minus(a, b, bits: int = 64):
    """a - b in ``bits`` wide words."""
    if isinstance(a, np.ndarray):
        return (a - b) & np.uint64((1 << bits) - 1)
    return (a - b) & ((1 << bits) - 1)


def _plus(a, b):
    return a + b if isinstance(a, np.ndarray) else (a + b) & MASK64


_romu("romuduo", "RomuDuo", lambda seed: (seed or PHI,) * 2,
      lambda x, y: (_times(ROMU64, y), _minus(_plus(_rotated(y, 36, 64), _rotated(y, 15, 64)), x)))
_romu("romuduojr", "RomuDuoJr", lambda seed: (seed or PHI,) * 2, lambda x, y: (_times(ROMU64, y), _rotated(_minus(y, x), 27, 64)))
_romu("romutrio", "RomuTrio", lambda seed: (seed, 1, 1),
      lambda x, y, z: (_times(ROMU64, z), _rotated(_minus(y, x), 12, 64), _rotated(_minus(z, y), 44, 64)))
_romu("romutrio32", "RomuTrio32", lambda seed: ((seed or PHI) & 0xFFFFFFFF, (seed or PHI) >> 32, 0),
      lambda x, y, z: (_times(ROMU32, z, 32), _rotated(_minus(y, x, 32), 6, 32), _rotated(_minus(z, y, 32), 22, 32)), 32)
