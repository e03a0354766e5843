"""The per-decade report in one call: share matrices as CSV (one file per
category) and the most frequent label per category and decade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..session import scratch_dir
from ..sources.papers import write_share_csv
from .trends import decade_label_counts, labelled_papers, top_labels, with_share


def decade_report(papers: DataFrame, labelled: DataFrame, out_dir: str,
                  labels: dict[str, Sequence[str]], run: int = 1, width: int = 10,
                  drop_invalid: bool = False) -> DataFrame:
    """Write ``<out_dir>/category=<c>`` share CSVs and return the top label
    per (category, decade). The share table (category x decade x label) is
    computed once and checkpointed into the shared scratch folder; both
    outputs read it."""
    scratch_dir(papers.sparkSession)
    counts = decade_label_counts(labelled_papers(papers, labelled, run=run, width=width,
                                                 drop_invalid=drop_invalid))
    shares = with_share(counts).checkpoint(eager=True)
    write_share_csv(shares, out_dir, labels, checkpoint=False)
    return top_labels(shares, 1)


def repeat_study(spark, papers: DataFrame, labelled: DataFrame, vocab: DataFrame, fn,
                 categories: Sequence[str], n: int = 10, seed: int = 0, extra_runs: int = 4,
                 **labelling) -> dict[str, DataFrame]:
    """Label a deterministic sample of ``n`` papers ``extra_runs`` more times
    (runs 2, 3, ...) and measure how consistently each paper gets the same
    label. Run 1 comes from ``labelled``. Returns the labels, per-paper
    scores, mean per category, box statistics and the paper x category
    matrix."""
    from .agree import consistency, consistency_box, consistency_by_category, consistency_matrix
    from .labelling import label_collection
    from .sample import sample_papers
    picked = sample_papers(papers, n, seed)
    ids = picked.select("paper_id")
    again = label_collection(spark, picked, vocab, fn, categories, runs=extra_runs, first_run=2,
                             **labelling)
    base = labelled.filter("run = 1").join(ids, "paper_id", "left_semi").select(*again.columns)
    lab = base.unionByName(again)
    scores = consistency(lab)
    return {"labels": lab, "scores": scores,
            "by_category": consistency_by_category(scores),
            "box": consistency_box(scores),
            "matrix": consistency_matrix(scores, categories)}
