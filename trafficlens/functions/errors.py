"""Error taxonomy of upstream exceptions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import settings as S


def classify_error(provider: Column, name: Column) -> Column:
    """Error class of an upstream exception, by its own name or the name it is logged under.

    Clients raise subclasses; the table lists the public ones under the class that catches them
    (more specific bases first). A name in neither list is ``other``, also for a known provider.
    """
    table = F.create_map(*[F.lit(v) for p, n, c in S.ERROR_CLASSES for v in (f"{p}:{n}", c)])
    known = F.try_element_at(table, F.concat(provider, F.lit(":"), name))
    logged = F.try_element_at(F.create_map(*[F.lit(x) for pair in S.LOGGED_ERRORS for x in pair]), name)
    return F.coalesce(logged, known, F.lit("other"))


def error_handling(error_class: Column) -> Column:
    """What the caller does next: retry, give up, or move to the next provider."""
    return (
        F.when(error_class.isin(S.RETRYABLE), "retryable")
        .when(error_class.isin(S.FATAL), "fatal")
        .otherwise("next_provider")
    )
