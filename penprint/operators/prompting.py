"""Prompt-set and fine-tuning data jobs (SURVEY F4, F5, E7, E8, E9, G-5, A3, A4, A5, A9,
I13, I16, I17).

Per repetition the reference draws ``n`` authors and two texts per author with unseeded
``random``; here both draws are seeded md5 orderings.  The author draw runs on the
per-author table exploded by repetition; the text draw is a top-2 per (rep, author)
planned as a partial WindowGroupLimit, so at most two rows per group and map task
cross the shuffle however large an author is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.functions import prompts as P
from penprint.functions.text import DEFAULT_COUNTER, TokenCounter
from penprint.operators.metrics import macro_metrics, rep_mean_std
from penprint.operators.ranking import DEFAULT_SEED, first_k_in_group, hash_key, rank_in_group
from penprint.operators.sampling import author_counts
from penprint.session import reuse


def check_prompt_args(n_authors: int, reps: int | None = None) -> None:
    """At least two authors; at least one repetition (prompt sets only)."""
    if reps is not None and reps < 1:
        raise ValueError(f"need one repetition or more, got {reps}")
    if n_authors < 2:
        raise ValueError(f"need two authors or more, got {n_authors}")


def draw_authors(counts: DataFrame, n_authors: int | None, reps: int, seed=DEFAULT_SEED) -> DataFrame:
    """``(rep, label, author_idx, n_texts)``: per repetition ``n`` authors drawn uniformly
    from all authors (``None`` = all of them, in label order, as F5)."""
    per_rep = counts.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    if n_authors is None:
        # every author, in label order: exact bucketed rank
        ranked = rank_in_group(per_rep, ["rep"], ["label"], "label", "range", rank_col="_r")
        return (ranked.withColumn("author_idx", F.col("_r").cast("int"))
                .drop("_r", "_group_n"))
    per_rep = per_rep.withColumn("_k", hash_key(seed, F.lit("authors"), "rep", "label"))
    drawn = first_k_in_group(per_rep, ["rep"], ["_k", "label"], n_authors, rank_col="_rn")
    return drawn.withColumn("author_idx", (F.col("_rn") - 1).cast("int")).drop("_k", "_rn")


def sample_two_per_author(clean: DataFrame, n_authors: int | None, reps: int = 1,
                          seed=DEFAULT_SEED, check: bool = True) -> DataFrame:
    """``(rep, label, author, query_text, example_text)``.

    ``label`` is the author's 0-based position in the draw (F4) or in label order (F5).
    Raises like the reference when ``n`` exceeds the number of authors or a drawn author
    has fewer than two texts (checked on the per-author table only).
    """
    if reps < 1 or n_authors is not None:
        check_prompt_args(2 if n_authors is None else n_authors, reps)
    clean = reuse(clean)                 # read by the author draw and the text draw
    counts = author_counts(clean)
    if check and n_authors is not None:
        if counts.count() < n_authors:
            raise ValueError(f"{n_authors} authors asked for, the corpus has fewer")
    drawn = draw_authors(counts, n_authors, reps, seed)
    if check:
        short = drawn.filter(F.col("n_texts") < 2).select("label").limit(1).collect()
        if short:
            raise ValueError(f"author {short[0]['label']} has fewer than two texts")
    # ``drawn`` has at most n x reps rows (parameters): a proven bound, so it is broadcast
    # and the corpus is never shuffled by author before the per-group top-2.
    bounded = drawn.select("rep", "label", "author_idx")
    # Ranks run on ids alone; the text of the two winners a group is fetched afterwards.
    rows = clean.select("doc_id", "label").join(F.broadcast(bounded) if n_authors is not None else bounded, "label")
    rows = rows.withColumn("_k", hash_key(seed, F.lit("texts"), "rep", "doc_id"))
    two = first_k_in_group(rows, ["rep", "label"], ["_k", "doc_id"], 2, rank_col="_rn").drop("_k")
    if n_authors is not None:
        two = F.broadcast(two)           # at most 2 x n x reps ids
    two = clean.select("doc_id", "text").join(two, "doc_id")
    return (two.groupBy("rep", "label", "author_idx")
            .agg(F.max(F.when(F.col("_rn") == 1, F.col("text"))).alias("query_text"),
                 F.max(F.when(F.col("_rn") == 2, F.col("text"))).alias("example_text"))
            .select(F.col("rep").cast("int").alias("rep"), F.col("author_idx").alias("label"),
                    F.col("label").alias("author"), "query_text", "example_text"))


def authors_per_rep(prompt_set: DataFrame) -> DataFrame:
    """Distinct labels per repetition (the reader keeps the first value)."""
    return prompt_set.groupBy("rep").agg(F.countDistinct("label").alias("n_authors"))


def example_block(prompt_set: DataFrame, word: str = P.EXAMPLE_WORD) -> DataFrame:
    """Per repetition one string of ``<word> <label>: <example>`` lines in label order.
    A repetition holds ``n`` rows, so the collected list is bounded by ``n``."""
    entries = F.sort_array(F.collect_list(F.struct("label", "example_text")))
    return prompt_set.groupBy("rep").agg(F.array_join(F.transform(entries, lambda e: F.concat(
        F.lit(word + " "), e["label"].cast("string"), F.lit(": "), e["example_text"])), "\n")
        .alias("examples"))


def example_json(prompt_set: DataFrame) -> DataFrame:
    """Per repetition a JSON object ``{"label": example, ...}`` in label order,
    formatted like Python's ``json.dumps(..., ensure_ascii=False)``."""
    entries = F.sort_array(F.collect_list(F.struct("label", "example_text")))
    body = F.array_join(F.transform(entries, lambda e: F.concat(
        P.json_string(e["label"].cast("string")), F.lit(": "), P.json_string(e["example_text"]))), ", ")
    return prompt_set.groupBy("rep").agg(F.concat(F.lit("{"), body, F.lit("}")).alias("example_json"))


def number_rows(df: DataFrame, seed=DEFAULT_SEED, prefix: str = "request_") -> DataFrame:
    """G-3 + G-5: shuffle by a seeded key and number the rows ``request_0..`` globally.

    Uses the bucketed global rank (no single-partition window) on the row keys alone."""
    keyed = df.select("rep", "label").withColumn("_k", hash_key(seed, F.lit("shuffle"), "rep", "label"))
    ranked = rank_in_group(keyed, [], ["_k", "rep", "label"], "_k", "hex", rank_col="_i")
    ranked = df.join(ranked, ["rep", "label"])
    return (ranked.withColumn("custom_id", F.concat(F.lit(prefix), F.col("_i").cast("string")))
            .withColumn("request_idx", F.col("_i")).drop("_k", "_i", "_group_n"))


def finetune_requests(prompt_set: DataFrame, seed=DEFAULT_SEED) -> DataFrame:
    """I17 body: examples as JSON on every row of the repetition (E9), shuffle and number
    (G-3, G-5), render the request messages (B17) and the request envelope (A3)."""
    prompt_set = reuse(prompt_set)       # n x reps rows, read twice
    ej = example_json(prompt_set)
    rows = prompt_set.join(ej, "rep")          # one JSON row per repetition
    rows = number_rows(rows, seed)
    msgs = P.render_messages(P.FINETUNE_REQUEST_TEMPLATE, {
        "query_text": F.col("query_text"), "example_text": F.col("example_json"),
        "correct_author": F.col("label")}, fill_all=False)
    body = F.struct(F.lit(P.REQUEST_MODEL).alias("model"), msgs.alias("messages"),
                    F.lit(P.REQUEST_MAX_TOKENS).alias("max_tokens"),
                    F.lit(P.REQUEST_TEMPERATURE).alias("temperature"))
    return rows.select("custom_id", "request_idx", "rep", "label", "query_text", "example_json",
                       F.lit(P.REQUEST_METHOD).alias("method"), F.lit(P.REQUEST_URL).alias("url"),
                       body.alias("body"))


def export_requests(requests: DataFrame, path: str) -> None:
    """A3: one JSON object per line, non-ASCII kept, in request order."""
    (requests.orderBy("request_idx")
     .select(F.to_json(F.struct("custom_id", "method", "url", "body")).alias("value"))
     .write.mode("overwrite").text(path))


def write_prompt_set(prompt_set: DataFrame, path: str) -> None:
    """A4: CSV with the repetition as first column."""
    (prompt_set.select("rep", "label", "query_text", "example_text").orderBy("rep", "label")
     .write.mode("overwrite").option("header", True).option("escape", '"').csv(path))


def read_prompt_set(spark, path: str) -> tuple[DataFrame, int]:
    """A4 reader: the set and its authors-per-repetition (first repetition's value)."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .schema("rep int, label int, query_text string, example_text string").csv(path))
    first = authors_per_rep(df).orderBy("rep").limit(1).collect()
    return df, (int(first[0]["n_authors"]) if first else 0)


def prompt_inputs(prompt_set: DataFrame, template_name: str, max_tokens: int = P.DEFAULT_MAX_TOKENS,
                  max_new_tokens: int = P.DEFAULT_MAX_NEW_TOKENS, counter: TokenCounter = DEFAULT_COUNTER) -> DataFrame:
    """I13 first half: crop texts to the per-text budget (B15, B16; tokens of ``counter``), build
    each repetition's example block (E8) and render one prompt per query (B17)."""
    template = P.load_template(template_name)
    prompt_set = reuse(prompt_set)       # n x reps rows, read twice
    n = authors_per_rep(prompt_set)
    budget = P.token_budget(F.col("n_authors"), P.template_tokens(template, counter), max_tokens, max_new_tokens)
    cropped = (prompt_set.join(n, "rep")
               .withColumn("budget", budget)
               .withColumn("query_text", P.crop_to_budget("query_text", F.col("budget"), counter))
               .withColumn("example_text", P.crop_to_budget("example_text", F.col("budget"), counter)))
    blocks = example_block(cropped)
    rows = cropped.join(blocks, "rep")
    msgs = P.render_messages(template, {"query_text": F.col("query_text"), "example_text": F.col("examples")})
    return rows.select("rep", "label", "query_text", "examples", msgs.alias("messages"))


def score_responses(responses: DataFrame, json_answers: bool = False) -> tuple[DataFrame, DataFrame]:
    """I13 second half: parse each ``(rep, label, response)`` (B18 / B18b), compare label
    and answer as strings, score each repetition (E5) and average them (E6)."""
    parse = P.parse_json_response if json_answers else P.parse_response
    parsed = responses.select("rep", F.col("label").cast("string").alias("label"),
                              parse("response").alias("r"))
    rows = parsed.select(F.col("r.analysis").alias("analysis"), F.col("r.answer").alias("answer"),
                         "label", F.col("rep").cast("string").alias("rep"))
    per_rep = macro_metrics(rows, "label", "answer", ["rep"])
    return rows, rep_mean_std(per_rep)


def write_results(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """A5: averages / deviations and all response rows as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/data")


def sft_rows(prompt_set: DataFrame, responses: DataFrame, seed=DEFAULT_SEED,
             test_size: float = 0.1) -> DataFrame:
    """A9 + B19: SFT rows (query, examples as JSON, response, label) rendered to one chat
    string, then a seeded train/test split with ``ceil(test_size * n)`` test rows."""
    prompt_set = reuse(prompt_set)
    ej = example_json(prompt_set)
    rows = prompt_set.join(ej, "rep").join(responses.select("rep", "label", "response"), ["rep", "label"])
    parsed = F.from_json(F.col("example_json"), "map<string,string>")
    lines = F.array_join(F.transform(F.map_entries(parsed), lambda e: F.concat(
        F.lit(P.EXAMPLE_WORD + " "), e["key"], F.lit(": "), e["value"])), "\n")
    msgs = P.render_messages(P.SFT_TEMPLATE, {
        "query_text": F.col("query_text"), "example_text": lines,
        "response": F.col("response"), "label": F.col("label")}, fill_all=True)
    rows = rows.withColumn("chat", P.flatten_chat(msgs))
    keyed = rows.select("rep", "label").withColumn("_k", hash_key(seed, F.lit("sft"), "rep", "label"))
    ranked = rows.join(rank_in_group(keyed, [], ["_k", "rep", "label"], "_k", "hex"), ["rep", "label"])
    n_test = F.ceil(F.lit(float(test_size)) * F.col("_group_n"))
    return (ranked.withColumn("split", F.when(F.col("_rank") < F.col("_group_n") - n_test, "train")
                              .otherwise("test"))
            .select("rep", "label", "chat", "split"))
