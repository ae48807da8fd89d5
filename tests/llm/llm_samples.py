"""Texts for tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(("an", "er", "the", "ou", "st", "ing", "re")) for _ in range(rng.randint(1, 3))) for _ in range(n))
