"""A training corpus from ``documents``: known languages, one of each group of near
duplicates, no benchmark passages, no secrets, packed sequences."""

import public_tokenizers

from pairscreen.llm import decontaminate, languages, near_copies, packing, secret_scan
from pairscreen.session import materialise
from pairscreen.sources.tables import load

#: Tokenizers cannot be said in SQL; tests compare the rows with a plain version.
ORACLE_SQL = None


def language_id(spark, docs, sf_dir):
    """Documents whose language can be told stay."""
    return languages.keep_known(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near duplicates (five-word Jaccard of at least
    0.8) stays."""
    return near_copies.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Documents with benchmark passages go."""
    return decontaminate.remove_contaminated(docs, load(spark, sf_dir, "benchmark"))


def secrets(spark, docs, sf_dir):
    """Secrets are replaced by a mark; ``n_chars`` follows the text."""
    return secret_scan.redact(docs, length_col="n_chars")


def packed(spark, docs, sf_dir):
    """Token ids in sequences of at most 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packed),
]


def run(spark, sf_dir):
    """All stages over ``documents``, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
