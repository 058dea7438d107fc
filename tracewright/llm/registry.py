"""The subpackage's queries and their SQL."""

from __future__ import annotations

from tracewright.llm import chat, langid, maincut, manifest, mixing, ngram_join, periods, pieces, pii, quality, repeats, simhash, warc


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_mixing": mixing.op2_mixing,
        "op3_chat_format": chat.op3_chat_format,
        "op4_suffix_dedup": repeats.op4_suffix_dedup,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_language_id": langid.op6_language_id,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_simhash": simhash.op8_simhash,
        "op9_warc": warc.op9_warc,
        "op10_pii": pii.op10_pii,
        "op11_manifest": manifest.op11_manifest,
        "op12_periods": periods.op12_periods,
        "op13_main_text": maincut.op13_main_text,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngram_join.SQL, "op3_chat_format": chat.SQL, "op4_suffix_dedup": repeats.SQL, "op7_quality_rules": quality.SQL, "op9_warc": warc.SQL,
        "op11_manifest": manifest.SQL, "op13_main_text": maincut.SQL,
    }
