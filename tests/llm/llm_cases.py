"""Hand-written rows for the operator tests."""

import public_tokenizers

SF_DIR = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Names that the operators use inside; extra columns with them must not disturb.
CLASHES = [
    "row", "_row", "fp", "word", "words", "n", "w", "part", "chunk", "seg", "kept", "score", "least",
    "lang_pred", "component_id", "n_bytes", "shard", "slot", "_part", "_key", "doc", "hits", "phrase",
]


LONG = " ".join(f"word{i % 7919} and{i % 13}" for i in range(30_000))
#: Nulls, empty and very long texts, ties and repeated rows.
EDGES = [
    (1, ""),
    (2, None),
    (3, "the same text stands here twice, and it is long enough to hold fifty bytes and more"),
    (3, "the same text stands here twice, and it is long enough to hold fifty bytes and more"),
    (None, "the same text stands here twice, and it is long enough to hold fifty bytes and more"),
    (4, "   \t\n "),
    (5, LONG),
    (6, LONG + " tail"),
    (7, "12 34 !?"),
    (8, "one"),
    (None, None),
]
