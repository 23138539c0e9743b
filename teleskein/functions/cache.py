"""Keep large Column expressions once built.

A Column is only a description, but building a big one takes thousands of calls into the
JVM. The decode expressions depend on nothing but the signal, so each is built once per JVM.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext


def built_once(build):
    kept: dict = {}

    @functools.wraps(build)
    def get(*args):
        context = SparkContext._active_spark_context
        key = (id(context._gateway) if context else None, args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get
