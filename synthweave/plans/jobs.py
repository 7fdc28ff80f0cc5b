"""Composed jobs (C1-C9): the reference's scripts as single Spark DAGs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthweave.functions.templates import SIMILARITY_CUT
from synthweave.session import stored
from synthweave.operators import generate as G
from synthweave.operators import normalize as N
from synthweave.operators import parse as X
from synthweave.operators import prompts as R
from synthweave.operators import sample as M
from synthweave.operators import similarity as SIM
from synthweave.operators.privacy import ORDERS, rdp_ledger
from synthweave.sources import fixtures as V

GEN_SEED = 11


def job_prepare(raw: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(filtered) raw alpaca rows -> exact sample -> canonical rows."""
    sampled = M.sample_exact(raw, n, seed=seed)
    return N.alpaca_format(sampled).select("row_id", "instruction", "response")


def normalize_many(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """P6 over the raw layout of every dataset it knows, then the per-dataset shuffle + limit (M3)."""
    pairs = V.v_pairs(spark, sf_dir)
    alp = V.v_alpaca(spark, sf_dir)
    layouts = {
        "gsm8k": pairs.select("row_id", F.col("instruction").alias("question"), F.col("response").alias("answer")),
        "lighteval/MATH": pairs.select("row_id", F.col("instruction").alias("problem"),
                                       F.col("response").alias("solution"), F.lit("1").alias("level"),
                                       F.lit("algebra").alias("type")),
        "medalpaca/medical_meadow_medical_flashcards": pairs.select(
            "row_id", F.lit("Answer this question truthfully").alias("instruction"),
            F.concat("instruction", F.lit("?")).alias("input"), F.col("response").alias("output")),
        "WizardLM/WizardLM_evol_instruct_70k": alp.select("row_id", "instruction", "output"),
        "lmsys/chatbot_arena_conversations": V.v_arena(spark, sf_dir).select(
            F.col("conv_id").alias("row_id"), *[F.lit("x").alias(c) for c in N.ARENA_DROPPED], "conversation_a", F.col("conversation_a").alias("conversation_b")),
    }
    with_input = alp.select("row_id", "instruction", "input", "output")
    layouts |= dict.fromkeys(("lucasmccabe-lmi/CodeAlpaca-20k", "yahma/alpaca-cleaned"), with_input)
    layouts |= dict.fromkeys(("tatsu-lab/alpaca", "vicgalle/alpaca-gpt4", "gbharti/finance-alpaca"), alp.select("row_id", "instruction", "input", "output", "text"))
    canonical = pairs.select("row_id", "instruction", "response")
    layouts |= dict.fromkeys(("iamtarun/python_code_instructions_18k_alpaca", "FinGPT/fingpt-sentiment-train", "TIGER-Lab/MathInstruct", "new"), canonical)
    parts = [N.normalize_sft(name, df).select(F.lit(name).alias("dataset"), "row_id", "instruction", "response")
             for name, df in layouts.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return M.sample_per_group(union, "dataset", n, seed=2023).select("dataset", "row_id", "instruction", "response")


def _rounds(corpus: DataFrame) -> DataFrame:
    """One generation round per private row (the synthetic set mirrors its size)."""
    return corpus.select(F.col("row_id").alias("round_id"))


class _Corpus:
    """The private corpus with its position index, built once per job.

    Both the few-shot sampler and the replay generator look rows up by
    position.  They share one stored table of row ids and positions; texts
    are read from the corpus and joined by row id where they are needed.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.df = V.v_corpus(spark, sf_dir)
        self.indexed = stored(M.position_index(self.df))

    def draws(self, rounds: DataFrame, seed: int = 0) -> DataFrame:
        return M.fewshot_draw(self.df, rounds, seed=seed, indexed=self.indexed)

    def replay(self, prompts: DataFrame, text, seed: int) -> DataFrame:
        return G.generate_replay(prompts, self.df, text, seed=seed, indexed=self.indexed)


def icl_draws(spark: SparkSession, sf_dir: str, seed: int = 0) -> DataFrame:
    c = _Corpus(spark, sf_dir)
    return c.draws(_rounds(c.df), seed)


def icl_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.prompt_icl(icl_draws(spark, sf_dir))


def _generated(generations: DataFrame) -> DataFrame:
    """A generator's output, written once as a compressed table; its files are dealt to all tasks, which parse it next."""
    return stored(generations.select("round_id", "generation"))


def _icl_parts(spark: SparkSession, sf_dir: str):
    c = _Corpus(spark, sf_dir)
    draws = c.draws(_rounds(c.df))
    gen = _generated(c.replay(R.prompt_icl(draws), G.wrap_generation(), GEN_SEED))
    return c, draws, gen


def icl_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 prompts answered by the replay backend (L1)."""
    return _icl_parts(spark, sf_dir)[2]


def _parsed_ok():
    return (F.col("instruction").isNotNull() & (F.col("instruction") != "")
            & F.col("output").isNotNull() & (F.col("output") != ""))


def _verdicts(parsed: DataFrame, draws: DataFrame) -> DataFrame:
    """F4 -> F5 -> F6: 'unparsed' (dropped), 'failed' or 'kept'."""
    ok = _parsed_ok()
    gate = SIM.similarity_gate(parsed.where(ok).select("round_id", "instruction"),
                               draws.select("round_id", "slot", "row_id", "instruction"))
    verdict = (F.when(~ok, "unparsed")
               .when((F.col("max_sim") > SIMILARITY_CUT) | (F.length("instruction") <= 1) | (F.length("output") <= 1), "failed")
               .otherwise("kept"))
    return parsed.join(gate.select("round_id", "max_sim"), "round_id", "left").withColumn("verdict", verdict)


def job_icl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw -> prompt -> generate -> parse -> gate -> verdict.

    One DataFrame carries every verdict; writers split it with
    ``partitionBy('verdict')`` in a single pass (S7).  ``index_list`` holds
    the row ids of the round's exemplars, in prompt order.
    """
    _, draws, gen = _icl_parts(spark, sf_dir)
    parsed = stored(X.parse_pair(gen, "generation").select("round_id", "instruction", "output"))      # read by the gate and the verdicts
    few = F.array_sort(F.collect_list(F.struct("slot", "row_id")))            # a prompt's few exemplars
    exemplars = draws.groupBy("round_id").agg(F.transform(few, lambda x: x["row_id"]).alias("index_list"))
    return _verdicts(parsed, draws).join(exemplars, "round_id")


def icl_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, draws, gen = _icl_parts(spark, sf_dir)
    parsed = stored(X.parse_pair(gen, "generation").select("round_id", "instruction", "output"))
    return SIM.similarity_gate(parsed.where(_parsed_ok()).select("round_id", "instruction"),
                               draws.select("round_id", "slot", "row_id", "instruction"))


def _stage1(c: _Corpus) -> DataFrame:
    draws = c.draws(_rounds(c.df))
    gen = _generated(c.replay(R.prompt_self1(draws), G.wrap_generation(), GEN_SEED))
    parsed = stored(X.parse_instruction(gen, "generation").select("round_id", "instruction"))
    ok = F.col("instruction").isNotNull() & (F.col("instruction") != "")
    gate = SIM.similarity_gate(parsed.where(ok), draws.select("round_id", "slot", "row_id", "instruction"))
    return (parsed.where(ok).join(gate, "round_id")
            .where(~F.col("similar") & (F.length("instruction") > 1))
            .select("round_id", "instruction"))


def stage1_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: instruction-only generation, kept when parsed, dissimilar and long enough."""
    return _stage1(_Corpus(spark, sf_dir))


def job_self_instruct(spark: SparkSession, sf_dir: str, icl: bool = True) -> DataFrame:
    """Stage 1 (C4), a fresh draw per kept instruction, answer prompt, parse, keep non-empty."""
    c = _Corpus(spark, sf_dir)
    kept = stored(_stage1(c))          # stage 1's output feeds three places of stage 2
    draws2 = c.draws(kept.select("round_id"), seed=1) if icl else None
    prompts = R.prompt_self2(kept, draws2, icl=icl)
    gen = _generated(c.replay(prompts, F.col("response"), GEN_SEED + 1))
    out = X.parse_output(gen, "generation")
    return (out.join(kept, "round_id").where(F.col("output").isNotNull() & (F.col("output") != ""))
            .select("round_id", "instruction", "output"))


def job_reanswer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route each instruction to its domain prompt, answer, join back on row_id.

    The stored instruction is the original one (not the trimmed news cut).
    """
    corpus = V.v_corpus(spark, sf_dir)
    prompts = corpus.select(
        F.col("row_id").alias("round_id"),
        F.when(F.col("category") == "en", "FinGPT-news").otherwise("ChatDoctor").alias("dataset"),
        "instruction").select("round_id", R.routed_expr().alias("prompt"))
    answers = G.generate_replay(prompts, V.v_pairs(spark, sf_dir), F.col("response"), seed=GEN_SEED + 2)
    return (answers.join(corpus.select(F.col("row_id").alias("round_id"), "instruction"), "round_id")
            .where(F.col("generation").isNotNull() & (F.col("generation") != ""))
            .select(F.col("round_id").alias("row_id"), "instruction", F.col("generation").alias("output")))


def job_fed_round(updates: DataFrame, sizes: DataFrame, participants: DataFrame, glob: DataFrame) -> DataFrame:
    """One aggregation round (round 0 participants, FedAvg) and the change it makes."""
    from synthweave.operators.federated import fed_avg
    new = fed_avg(updates, sizes, participants.where(F.col("round") == 0))
    return (new.join(glob.withColumnRenamed("value", "g"), ["key", "pos"])
            .select("key", "pos", "value", (F.col("value") - F.col("g")).alias("change")))


def loss_matrix(losses: DataFrame, clients: DataFrame, n_rounds: int) -> DataFrame:
    """J6 + F10: the ``[client][round]`` loss table from ``losses (round, client_id, loss)``; -1 where a client did not train."""
    grid = (clients.select("client_id")
            .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(n_rounds - 1)))))
    return (grid.join(losses, ["round", "client_id"], "left")
            .select(F.col("round").cast("int").alias("round"), "client_id",
                    F.coalesce(F.col("loss"), F.lit(-1.0)).alias("loss")))


def over_budget(runs: DataFrame, run_key: list[str], every: int, total: int, max_eps: float, orders: tuple[int, int] = ORDERS) -> DataFrame:
    """The ledger at every ``every`` steps; rows where epsilon exceeds the budget."""
    ck = (runs.withColumn("steps", F.explode(F.sequence(F.lit(every), F.lit(total), F.lit(every))))
          .withColumn("steps", F.col("steps").cast("bigint")))
    led = rdp_ledger(ck, run_key + ["steps"], orders=orders)
    return led.where(F.col("epsilon") > max_eps).select(*run_key, "steps", "epsilon")
