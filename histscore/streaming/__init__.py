"""Intentionally empty.

The reference processes bounded files only: it has no unbounded source, no
watermark, no event-time window and no stateful operator (its "streaming"
collect is an out-of-core batch mode, which Spark's spilling execution
already covers). Nothing here is built, so the package adds no operator the
reference does not have.
"""
