"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame. ``run`` applies them to ``documents`` in order; each
result is written to the shared checkpoint folder and read back as the next
stage's documents. Every stage works on all documents its predecessor kept:

* toxicity drops documents scored 0.7 or more (a machine fitted on labels);
* exact dedup keeps the largest id of equal texts (A-Z lower-cased);
* near dedup keeps the smallest id of documents linked by SimHash at 4 bits;
* mixing repeats documents towards the sources' target weights, at most three
  times each; a source's last document may be cut;
* packing puts all that is left into sequences of at most 2048 tokens.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from spendpace.llm import exact_dedup, mixing, packing, simhash, toxicity
from spendpace.llm.common import stage, table


def drop_toxic(spark, docs, sf_dir):
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark, docs, sf_dir):
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark, docs, sf_dir):
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def mix_sources(spark, docs, sf_dir):
    return mixing.mixed(docs)


def pack_sequences(spark, docs, sf_dir):
    return packing.digests(packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the fingerprints and the tokenizer have no SQL form; the
#: pipeline is tested stage by stage against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
    return docs
