"""Scalar expressions, written as Spark SQL text for ``selectExpr``, ``F.expr`` or SQL.

One expression is one string, parsed once in the JVM. Building the same thing operator by operator
from Python costs a round trip per operator, which for the longer formulas here takes longer than
running them.
"""
