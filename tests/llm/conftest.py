import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n words that depend on the seed only."""
    return lambda seed, n: " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture
def folder(tmp_path):
    """folder(name=DataFrame, ...): a folder with these tables."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"file://{tmp_path}/{name}.parquet")
        return f"file://{tmp_path}"

    return write


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
