"""Path helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path buckets, first match wins, and paths that count as internal.
BUCKETS = [
    ("test", r"(?:test|spec|__tests__|__mocks__|\.test\.|\.spec\.)"),
    ("config", r"(?:/config/|\.config\.|rc\.)"),
    ("utility", r"(?:/scripts?/|/tools?/|/utils?/|/helpers?/)"),
    ("source", r"(?:/src/|/lib/|/app/|/components?/)"),
    ("api", r"(?:/api/|/routes?/|/controllers?/)"),
]
INTERNAL_PATHS = (
    r"(?i)[/\\]scripts?[/\\]|[/\\]admin[/\\]|[/\\]internal[/\\]|[/\\]tools?[/\\]|[/\\]seed[/\\]"
    r"|[/\\]migrations?[/\\]|[/\\]fixtures?[/\\]"
)
TEST_PATHS = r"(?i)(?:test|spec|__tests__|__mocks__|\.test\.|\.spec\.)"
SOURCE_PATHS = r"(?i)(?:[/\\]src[/\\]|[/\\]lib[/\\]|[/\\]app[/\\]|[/\\]components?[/\\])"


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def path_bucket(path: Column) -> Column:
    low = F.lower(normal_path(path))
    name, pattern = BUCKETS[0]
    chain = F.when(low.rlike(pattern), name)
    for name, pattern in BUCKETS[1:]:
        chain = chain.when(low.rlike(pattern), name)
    return chain.otherwise("other")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(?:(.*)/)?[^/]*$", 1)
