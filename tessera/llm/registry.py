"""Queries of the text operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import filters, fingerprint, langid, media, mixing, pieces, sharding, simhash, substring, surrogates, toxicity, turns, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1_warc,
        "op3_langid": langid.op3_langid,
        "op4_simhash": simhash.op4_simhash,
        "op5_substring": substring.op5_substring,
        "op10_toxicity": toxicity.op10_toxicity,
        "op2_surrogates": surrogates.op2_surrogates,
        "op6_pieces": pieces.op6_pieces,
        "op7_media": media.op7_media,
        "op8_mixing": mixing.op8_mixing,
        "op9_fingerprint": fingerprint.op9_fingerprint,
        "op11_turns": turns.op11_turns,
        "op12_filters": filters.op12_filters,
        "op13_sharding": sharding.op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.OP1_SQL, "op8_mixing": mixing.OP8_SQL, "op11_turns": turns.OP11_SQL, "op12_filters": filters.OP12_SQL, "op13_sharding": sharding.OP13_SQL}
