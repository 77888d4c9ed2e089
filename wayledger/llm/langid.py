"""Language identification by compression: the smallest zstandard output among per-language dictionaries wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

UNDETERMINED = "und"


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    texts_per_language: int = 64,
) -> dict[str, bytes]:
    """Raw-content dictionaries of lower-cased text by language.

    The documented bound on what is learnt from: for each language the one text, whole, of smallest hash in each of
    ``texts_per_language`` hash buckets.  Null texts and null languages are left out.
    """
    h = F.xxhash64(text)
    picked = (
        docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0))
        .select(F.col(lang).alias("lang"), F.pmod(h, F.lit(texts_per_language)).alias("bucket"), F.struct(h, F.col(text)).alias("pick"))
        .groupBy("lang", "bucket")
        .agg(F.min("pick").alias("pick"))
        .select("lang", "bucket", F.col("pick")[text].alias("text"))
        .orderBy("lang", "bucket")
        .collect()
    )
    out: dict[str, list[str]] = {}
    for row in picked:
        out.setdefault(row.lang, []).append(row.text)
    return {k: "\n".join(v).lower().encode() for k, v in out.items()}


def classify(dictionaries: dict[str, bytes], min_margin: float = 0.01, block: int = 2048, min_match: int = 4):
    """A column function: text -> struct(lang, score, confident, margin).

    The whole text is compressed in blocks of ``block`` bytes, so that a long text's own repeats don't hide the
    dictionaries; matches of ``min_match`` bytes on tell languages apart better than the defaults.  ``margin`` is the relative gap between the two smallest totals; below ``min_margin`` the answer is
    rejected (``confident`` false) though the best guess is still named.  ``score`` is 0.5 at no gap and nears 1.  Null
    texts, texts without a letter and texts met with no dictionary at all give lang "und", score 0 and confident false.
    """
    shared = sorted(dictionaries.items())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import regex
        import zstandard

        letter = regex.compile(r"\p{L}").search
        names, coders = [k for k, _ in shared], []
        for _, content in shared:
            log = (len(content) + block).bit_length()  # the window and the tables hold all of the dictionary
            settings = zstandard.ZstdCompressionParameters(
                window_log=max(20, log), hash_log=max(17, log), chain_log=max(17, log), search_log=4, min_match=min_match, strategy=zstandard.STRATEGY_GREEDY, write_checksum=0, write_content_size=0, write_dict_id=0
            )
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=settings)
            coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=settings).compress)
        for texts in batches:
            rows = []
            for t in texts:
                if not names or not t or not letter(t):
                    rows.append((UNDETERMINED, 0.0, False, 0.0))
                    continue
                data = t.lower().encode()
                parts = [data[i : i + block] for i in range(0, len(data), block)]
                sizes = np.array([sum(len(c(p)) for p in parts) for c in coders])
                order = np.argsort(sizes, kind="stable")
                margin = float(sizes[order[1]] / sizes[order[0]] - 1) if len(order) > 1 else 1.0
                rows.append((names[order[0]], float(1 - 0.5 * np.exp(-20 * margin)), margin >= min_margin, margin))
            yield pd.DataFrame(rows, columns=["lang", "score", "confident", "margin"])

    return F.pandas_udf(run, "lang string, score double, confident boolean, margin double")


def predict(docs: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id", text: str = "text", keep: tuple[Column | str, ...] = (), **options) -> DataFrame:
    """key, kept columns, lang_pred, score, confident and margin for every row; repeated rows stay, other columns go."""
    out = in_small_batches(docs).select(key, *keep, classify(dictionaries, **options)(F.col(text)).alias("_p"))
    return out.select(*out.columns[:-1], F.col("_p.lang").alias("lang_pred"), "_p.score", "_p.confident", "_p.margin")
