"""Small tables with the awkward cases: nulls, empty texts, ties, repeated rows, clashing names."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * (seed % 5 + 1) + i) % len(WORDS)] + str((seed * 31 + i * 17) % 97) for i in range(n))


def documents(spark, rows):
    """rows: (doc_id, text); more columns whose names clash with what operators make inside."""
    full = [(i, t, "en", f"src{k % 3}", None if t is None else len(t), k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, d int")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
