"""Named query plans: what __spark_entry__ registers."""

from corpusloom.plans import corpus, evaluation, records, streaming  # noqa: F401  they register their queries
