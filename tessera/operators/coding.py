"""LLM coding as tables: prompts (T9), request table (J2), reply parsing.

The model call itself is outside Spark (an external batch service); these
operators produce the request table and read the reply table back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import col_of, pystrip


def build_prompts(codebook: DataFrame, role: str = fv.CODEBOOK_ROLE) -> DataFrame:
    """One prompt per code: role + definition block + instruction +
    clarification + examples, the alias/name put into one template literal."""
    before, after = fv.DEFINITION_TEMPLATE.split("{name}")
    between, end = after.split("{definition}")
    definition_block = F.concat(F.lit(before), F.col("name"), F.lit(between), F.col("definition"), F.lit(end))
    instruction = F.replace(F.replace(F.lit(fv.INSTRUCTION_TEMPLATE), F.lit("{name}"), F.col("name")),
                            F.lit("{alias}"), F.col("alias"))
    prompt = F.concat(F.lit(role), definition_block, instruction,
                      F.coalesce("clarification", F.lit("")), F.coalesce("examples", F.lit("")))
    return codebook.select("alias", prompt.alias("prompt"))


def request_table(df: DataFrame, codebook: DataFrame, key: str, text: str = "text",
                  role: str = fv.CODEBOOK_ROLE, max_codes: int | None = None) -> DataFrame:
    """One request per (row, code). The prompt table has one row per code;
    it is fetched once and every row expands into its requests with a
    row-local ``inline`` (no join, no shuffle). ``max_codes``: refuse more."""
    prompts = build_prompts(codebook, role).collect()
    if max_codes is not None and len(prompts) > max_codes:
        raise ValueError(f"more than {max_codes} codes")
    reqs = F.array(*[F.struct(F.lit(p.alias).alias("alias"), F.lit(p.prompt).alias("system_prompt"))
                     for p in prompts])
    return df.select(key, F.col(text).alias("user_text"), F.inline(reqs)).select(
        key, "alias", "system_prompt", "user_text")


def parse_reply_cols(reply, alias) -> dict[str, Column]:
    """T10 expressions: decision is 1 if ``{alias}_1`` occurs anywhere, the
    rationale (positive replies only) lies between the first and second
    ``{alias}_rationale:`` cut at ``{alias}_explanation:``; the explanation
    is what follows the first explanation marker up to a second one. All
    three stay NULL for an ``'error'`` or missing reply."""
    r, a = col_of(reply), col_of(alias)
    failed = r.isNull() | (r == F.lit(fv.ERROR_REPLY))
    dec_m, rat_m, exp_m = (F.concat(a, F.lit(m.removeprefix("{alias}")))
                           for m in (fv.DECISION_MARKER, fv.RATIONALE_MARKER, fv.EXPLANATION_MARKER))
    decision = F.when(F.contains(r, dec_m), F.lit(1)).otherwise(F.lit(0))
    rationale = F.when((decision == 1) & F.contains(r, rat_m),
                       pystrip(F.split_part(F.split_part(r, rat_m, F.lit(2)), exp_m, F.lit(1))))
    explanation = F.when(F.contains(r, exp_m), pystrip(F.split_part(r, exp_m, F.lit(2))))
    null_s = F.lit(None).cast("string")
    return {
        "decision": F.when(failed, F.lit(None).cast("int")).otherwise(decision),
        "rationale": F.when(failed, null_s).otherwise(rationale),
        "explanation": F.when(failed, null_s).otherwise(explanation),
    }


def parse_responses(df: DataFrame, reply: str = "reply", alias: str = "alias") -> DataFrame:
    """T10 on a long reply table (one row per row x code). If the output
    columns already exist (a re-run), a failed reply keeps the old values and
    any other reply replaces them all."""
    cols = parse_reply_cols(reply, alias)
    failed = F.col(reply).isNull() | (F.col(reply) == F.lit(fv.ERROR_REPLY))
    return df.withColumns({name: F.when(failed, F.col(name)).otherwise(expr) if name in df.columns else expr
                           for name, expr in cols.items()})


def replies_wide(parsed: DataFrame, key: str, codes: Sequence[str]) -> DataFrame:
    """Long parsed replies -> ``{code}_gpt``, ``{code}_rtnl_gpt``,
    ``{code}_expl_gpt`` per row (one shuffle on the row key, which a
    following join on the same key reuses). Expects one reply per
    (key, code); merge re-runs first with :func:`parse_responses`."""
    p = parsed.groupBy(key).pivot("alias", list(codes)).agg(
        F.first("decision").alias("gpt"), F.first("rationale").alias("rtnl_gpt"),
        F.first("explanation").alias("expl_gpt"))
    return p.withColumns({f"{c}_gpt": F.col(f"{c}_gpt").cast("double") for c in codes})


def code_requests(requests: DataFrame, client, key: str, out: str = "reply",
                  min_interval_s: float = 0.0, materialize: bool = True) -> DataFrame:
    """Run a model over the request table, one call per row, on the executors
    (``mapInPandas``: each task owns a slice of the requests, so calls spread
    over the cluster instead of one sequential driver loop). ``client`` is a
    picklable ``(system_prompt, user_text) -> str``; a failing call yields
    ``'error'``, which :func:`parse_responses` treats as "no reply".
    ``min_interval_s`` throttles calls per task. The result is
    ``(key, alias, reply)``. Model calls are not deterministic and cost money,
    so by default the replies are checkpointed at once (reliable storage under
    ``spark.checkpoint.dir``): a lost executor later never triggers new calls,
    and downstream parsing reads the stored replies."""
    import time

    from pyspark.sql.types import StringType, StructField, StructType
    key_type = requests.schema[key].dataType
    schema = StructType([StructField(key, key_type), StructField("alias", StringType()),
                         StructField(out, StringType())])

    def run(batches):
        import pandas as pd
        last = 0.0
        for pdf in batches:
            replies = []
            for system, user in zip(pdf["system_prompt"], pdf["user_text"]):
                wait = min_interval_s - (time.monotonic() - last)
                if wait > 0:
                    time.sleep(wait)
                try:
                    replies.append(" " + str(client(system, user)))
                except Exception:  # noqa: BLE001 - any failure is an 'error' reply
                    replies.append(fv.ERROR_REPLY)
                last = time.monotonic()
            yield pd.DataFrame({key: pdf[key], "alias": pdf["alias"], out: replies})

    replies = requests.select(key, "alias", "system_prompt", "user_text").mapInPandas(run, schema)
    if materialize:
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(replies.sparkSession)
        replies = replies.checkpoint(eager=True)
    return replies
