"""The corpus operators' queries, one per operator, over whole tables."""

from __future__ import annotations

from .common import table


def op1_packing(spark, sf_dir):
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark, sf_dir):
    from .quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark, sf_dir):
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_near_dedup(spark, sf_dir):
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_lm_scores(spark, sf_dir):
    from .ngram_lm import score

    return score(table(spark, sf_dir, "documents"))


def op6_pii(spark, sf_dir):
    from .pii import detect

    return detect(table(spark, sf_dir, "documents"))


def op7_media(spark, sf_dir):
    from .media import describe, store

    return describe(store(table(spark, sf_dir, "documents")))


def op8_html(spark, sf_dir):
    from .html_blocks import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op9_secrets(spark, sf_dir):
    from .secrets import ownership_text, secret_spans

    out = secret_spans(table(spark, sf_dir, "documents"))
    return out.withColumn("ownership", ownership_text(out["verdicts"])).drop("verdicts")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op")} | {"pipeline": pipeline}


def oracle_sql():
    """Trained models, tokenizer ids and containers are beyond SQL; those queries have brute-force tests."""
    from . import oracles

    return {"op4_decontamination": oracles.DECONTAMINATION, "op9_secrets": oracles.SECRETS, "op10_near_dedup": oracles.NEAR_DEDUP}
