"""The reference study's three flows, composed from the operators.

* :func:`agreement_report` / :func:`annotation_packets` - the agreement
  cycle: packets for two raters, then kappa, disagreements and counts.
* :func:`coding_requests` / :func:`triangulated_labels` - LLM coding as
  tables: requests out, replies in, human x model triangulation.
* :func:`training_set` - redaction, augmentation with lineage, a leak-safe
  calibration hold-out and train/test split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import agreement as agr
from ..operators import columns as cols
from ..operators import labels as lab
from ..operators import coding
from ..operators import entities as ent
from ..operators import rows as rws
from ..operators import sampling as smp
from ..operators import text as txt
from ..session import ensure_checkpoint_dir
from ..sources.io import write_partitions


def annotation_packets(pool: DataFrame, n: int, cycle: int, seed, key: str = "row_id",
                       out_dir: str | None = None, redact: bool = True, model=None) -> tuple[DataFrame, DataFrame]:
    """One cycle's packet for the first rater and its masked copy for the
    second; optionally written under ``out_dir`` (r1, r2) by cycle, to be read with
    ``read_partitions``: running a cycle again replaces it. Entities
    and names are redacted first (raters see no raw text), unless ``redact``
    is off for a pool that already is; ``model``: also those that a trained
    recogniser finds."""
    if redact and "text" in pool.columns:
        pool = txt.redact_spans(ent.detect_entities(pool, "text", "_tz_spans", model=model), "text", "_tz_spans").drop("_tz_spans")
        pool = txt.redact_terms(pool, ["text"])
    packet = smp.sample_by_cycle(pool, n, cycle, seed, key)
    masked = smp.masked_copy(packet, fv.CYCLE_TAG_COLUMNS)
    if out_dir:
        write_partitions(packet, f"{out_dir}/r1", ["cycle"])
        write_partitions(masked, f"{out_dir}/r2", ["cycle"])
    return packet, masked


def agreement_report(sheet_a: DataFrame, sheet_b: DataFrame, key: str, codes: Sequence[str] = tuple(fv.ALL_TAGS),
                     s1: str = "r1", s2: str = "r2") -> dict[str, DataFrame]:
    """Pair two raters' sheets, coerce their tags, and report kappa per code,
    row-level disagreements (tags and flags side by side, placeholders in
    empty text cells) and the value x column counts."""
    a = lab.normalize_tags(sheet_a, codes, "coerce")
    b = lab.normalize_tags(sheet_b, codes, "coerce")
    paired = agr.pair_annotators(a, b, key, s1, s2)
    tag_cols = [f"{c}_{s}" for c in codes for s in (s1, s2)]
    return {
        "kappa": agr.cohen_kappa(paired, codes, s1, s2),
        "disagreements": cols.fill_placeholders(cols.disagreements(paired, codes, s1, s2)).select(
            key, *[x for c in codes for x in (f"{c}_{s1}", f"{c}_{s2}", f"{c}_dis")],
            *[c for c in paired.columns if c != key and c not in tag_cols]),
        "counts": agr.value_counts(paired, tag_cols),
    }


def coding_requests(df: DataFrame, codebook: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One request row per (row, code) for an external batch LLM service."""
    return coding.request_table(df, codebook, key, text)


def triangulated_labels(human: DataFrame, replies: DataFrame, key: str,
                        codes: Sequence[str] = tuple(fv.LLM_CODES)) -> DataFrame:
    """Parse the reply table (key, alias, reply), widen it per code, keep a
    code only where human and model both say 1, and drop the interim columns.
    Human tags may be raw strings: blanks and integers (strict)."""
    human = lab.normalize_tags(human, list(codes), "strict")
    wide = coding.replies_wide(coding.parse_responses(replies), key, codes)
    tri = cols.triangulate(human.join(wide, key, "left"), codes)
    return cols.finalize_triangulated(tri, codes)


def theme_output(df: DataFrame, key: str = "row_id", themes: Sequence[str] = tuple(fv.THEMES)) -> DataFrame:
    """E3's second output: the rows with a theme, and their theme columns as
    numbers. The training set goes on without these columns."""
    d = lab.normalize_tags(df, list(themes), "coerce")
    return cols.any_positive(d, list(themes)).select(key, "text", *themes)


def training_set(df: DataFrame, key: str = "row_id", targets: Sequence[str] = tuple(fv.TARGETS),
                 n_calibrate: int = 200, test_size: float = 0.2, seed=56,
                 terms: Sequence[str] | None = None, materialize: bool = True,
                 faithful: bool = False, model=None) -> DataFrame:
    """Redact entities (with ``model``, also a trained recogniser's), then markers and names, in text and rationale,
    strip numerals, tags to numbers, drop the theme columns
    (:func:`theme_output` has them), flag targets, add rationale copies (with lineage), strip salience tokens,
    hold out ``n_calibrate`` rows by family (a copy never leaves its parent),
    and split the rest 80:20 by class with copies kept on the train side.
    Returns every row with ``split`` in calibrate / train / test.

    The cleaned, augmented rows feed several branches (family sizes, totals,
    class counts, ranks, the semi join); with ``materialize`` they are
    checkpointed once to ``spark.checkpoint.dir`` instead of being re-derived
    (and the text re-scanned) per branch.

    ``faithful`` reproduces the reference's two gaps: numerals are stripped
    from the text only (so rationale copies keep them) and the hold-out
    draws single rows (a copy can be held out while its parent trains).
    The default strips the rationale too and holds out whole families."""
    d = df
    for c in ["text"] if faithful else ["text", "rtnl"]:
        d = txt.redact_spans(ent.detect_entities(d, c, "_tz_spans", model=model), c, "_tz_spans").drop("_tz_spans")
    d = txt.redact_terms(d, ["text", "rtnl"], terms)
    d = txt.strip_numerals(d, "text")
    if not faithful:
        d = txt.strip_numerals(d, "rtnl")
    d = lab.normalize_tags(d, [c for c in targets if c in d.columns], "coerce").drop(*fv.THEMES)
    d = cols.composite_indicator(d, list(targets), "trgt")
    d = rws.augment(d, key)
    d = txt.strip_tokens(d, "text")
    d = d.withColumn("family", F.coalesce(F.col("parent_id"), F.col(key)))
    if materialize:
        ensure_checkpoint_dir(d.sparkSession)
        d = d.checkpoint(eager=True)
    held = smp.holdout(d, n_calibrate, seed, key, out="split", group=None if faithful else "family")
    cal = held.where(F.col("split") == "calibrate")
    rest = held.where(F.col("split") == "train").drop("split")
    return cal.unionByName(rws.assemble_train(rest, test_size, "trgt", seed, key).select(*cal.columns))
