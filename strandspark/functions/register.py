"""SQL functions: revcomp, kmers, and a model's affinity_sum, for spark.sql."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandspark.functions.alphabet import DNA, Alphabet


def register(spark: SparkSession, model=None, alphabet: Alphabet = DNA) -> None:
    """revcomp and kmers become temporary SQL functions (no Python); affinity_sum, with a model, a vectorised one."""
    letters, partners = alphabet.order, alphabet.partners
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION revcomp(seq STRING) RETURNS STRING RETURN reverse(translate(seq, '{letters}', '{partners}'))")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION kmers(seq STRING, k INT) RETURNS ARRAY<STRING> RETURN"
        " CASE WHEN length(seq) < k THEN CAST(array() AS ARRAY<STRING>) ELSE transform(sequence(1, length(seq) - k + 1), i -> substring(seq, i, k)) END"
    )
    if model is not None:
        from strandspark.functions.kernel import by_length
        from strandspark.operators.scoring import round_alphas

        @F.pandas_udf("double")
        def affinity(seq: pd.Series) -> pd.Series:
            seqs, out = seq.tolist(), [None] * len(seq)
            known = [i for i, s in enumerate(seqs) if s is not None]
            for _, index in by_length([seqs[i] for i in known]):
                for i, v in zip(index, round_alphas(model, [seqs[known[j]] for j in index], 0, 1, interactions=False)[:, 0], strict=True):
                    out[known[i]] = float(v)
            return pd.Series(out, dtype=float)

        spark.udf.register("affinity_sum", affinity)
