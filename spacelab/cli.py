"""Command line: python -m spacelab U T [M] [options].  Progress goes to stderr, the result line to stdout."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.runner import NonUniformGenerator, execute, header, print_to_stderr, report
from .plans.spec import Grid, Run, SpecError, parse_u64
from .sources.generators import UnknownGenerator, generator, generator_names


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("spacelab", description="Collision and birthday-spacings tests of pseudorandom generators on Spark.")
    p.add_argument("u", type=int, help="bits taken of each draw; a coordinate has 2^u values")
    p.add_argument("t", type=int, help="draws that make a point")
    p.add_argument("m", type=int, nargs="?", help="points of one of the 2^b passes")
    p.add_argument("-s", "--shift", type=int, default=0, metavar="S", help="bits skipped at the top of a draw")
    p.add_argument("-b", "--tradeoff-bits", type=int, metavar="B", help="count by the top B bits of the index")
    p.add_argument("-d", "--decimation-bits", type=int, metavar="D", help="drop points with a one among the last D bits of a coordinate")
    p.add_argument("-c", "--checkpoints", action="store_true", help="p-values at uniform checkpoints of a decimated scan")
    p.add_argument("-B", "--birthday-spacings", action="store_true", help="birthday-spacings test instead of the collision test")
    p.add_argument("-r", "--reps", type=int, default=1, help="repetitions along the same orbit")
    p.add_argument("-S", "--seed", default="0", help="start of the generator, as 123, 0x7B, 0o173 or 0b1111011, with _ where it helps")
    p.add_argument("-p", "--pretty-p", action="store_true", help="p-values close to 1 as 1 - eps")
    p.add_argument("-P", "--parallel", action="store_true", help="accepted for compatibility; runs are always parallel")
    p.add_argument("--pass", dest="only", type=int, metavar="K", help="only unit K of 2^B, with its share of the mean")
    p.add_argument("-g", "--generator", default="splitmix", help="one of: " + ", ".join(generator_names()))
    p.add_argument("--replay", action="store_true", help="count one unit after the other, each with a scan of its own, to need less disk")
    p.add_argument("--strict", action="store_true", help="fail if a bin exceeds its headroom")
    return p


def parse(arguments: list[str]) -> Run:
    """The run that the arguments describe; exits with status 2 on what no test has."""
    p = parser()
    a = p.parse_args(arguments)
    try:
        generator(a.generator)
        if a.decimation_bits is not None and a.decimation_bits < 1:
            raise SpecError("decimation bits must be at least 1")
        if a.tradeoff_bits is not None and a.tradeoff_bits < 1:
            raise SpecError("tradeoff bits must be at least 1")
        run = Run(
            Grid(a.u, a.t, a.shift, a.decimation_bits or 0), a.generator, a.m, a.tradeoff_bits or 0, a.birthday_spacings, a.checkpoints, a.reps,
            parse_u64(a.seed), a.only, a.pretty_p, a.strict, a.replay)
        run.check_size()
        run.samples  # noqa: B018  its range is checked
    except (SpecError, UnknownGenerator) as e:
        p.error(str(e))
    return run


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    run = parse(sys.argv[1:] if arguments is None else arguments)
    spark = spark or SparkSession.builder.appName("spacelab").getOrCreate()
    print_to_stderr(header(run))
    try:
        result = execute(spark, run)
    except NonUniformGenerator as e:
        print_to_stderr([str(e)])
        return 1
    print_to_stderr(report(result))
    print(result.line(), flush=True)
    return 0
