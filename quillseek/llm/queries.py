"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import anncells, chat, decontam, htmlblocks, langid, linededup, mixing, simhash, url_filter, warc


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_nearest_neighbours": anncells.query,
        "op2_line_dedup": linededup.query,
        "op3_warc": warc.query,
        "op4_mixing": mixing.query,
        "op5_decontamination": decontam.query,
        "op6_url_filter": url_filter.query,
        "op7_language_id": langid.query,
        "op8_chat_format": chat.query,
        "op9_simhash": simhash.query,
        "op10_html_blocks": htmlblocks.query,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.SQL, "op4_mixing": mixing.SQL, "op6_url_filter": url_filter.SQL}
