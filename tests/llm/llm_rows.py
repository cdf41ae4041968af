"""Made-up sentences and the schema of documents."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(seed: int, n: int, words: str = "the of and river stone light house green walk under over morning evening train letter paper window garden water bread") -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words.split()) + rng.choice(["", "", "s", "ing", ".", ","]) for _ in range(n))
