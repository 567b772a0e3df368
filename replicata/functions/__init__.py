"""Scalar expressions (Column -> Column), all of them built-in and JVM-side."""
