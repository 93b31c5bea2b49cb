"""Running user-supplied models over tables, and governing their answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..workdir import materialise

CONCURRENCY = 50
#: Rows whose prompts and answers a task holds at a time.
ROWS_HELD = 256
# What a checking model's answer holds when it objects.
OBJECTIONS = ("error", "invalid", "矛盾", "不一致")

#: A client takes prompt, image_url and ocr_text and gives text, tokens in and tokens out.
Client = Callable[[str | None, str | None, str | None], tuple[str | None, int, int]]


def echo_client() -> Client:
    """A deterministic stand-in for a model: the prompt's length and last line."""

    def infer(prompt, image, text):
        prompt = prompt or ""
        answer = f"{len(prompt)}:{prompt.rstrip().rpartition(chr(10))[2][:80]}"
        return answer, len(prompt), len(answer)

    return infer


def infer_rows(requests: DataFrame, factory: Callable[[], Client] = echo_client, partitions: int | None = CONCURRENCY, image: str = "image_url", ocr: str = "ocr_text") -> DataFrame:
    """Adds content, tokens_in, tokens_out and infer_error, replacing columns of these names. A client is made once per partition; a failed call gives a row with its error.

    ``partitions`` bounds how many calls run at once. Equal requests are each
    sent; cached_inference_join() and dropDuplicates come before, where wanted.
    """
    added = ("content", "tokens_in", "tokens_out", "infer_error")
    requests = requests.drop(*added)
    df = requests.repartition(partitions) if partitions else requests
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in requests.schema)}, content string, tokens_in bigint, tokens_out bigint, infer_error string"
    return df.mapInArrow(lambda batches: _answers(batches, factory(), image, ocr), schema)


def _answers(batches: Iterator[pa.RecordBatch], client: Client, image: str, ocr: str) -> Iterator[pa.RecordBatch]:
    """Batches of up to ROWS_HELD rows with their answers. Only what the client takes becomes Python objects; other columns pass as they are."""

    def one(*asked) -> tuple:
        try:
            return (*client(*asked), None)
        except Exception as e:  # a model's failure belongs to its row
            return None, 0, 0, f"{type(e).__name__}: {e}"

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_HELD):
            part = batch.slice(at, ROWS_HELD)
            asked = (part.column(c).to_pylist() if c in part.schema.names else [None] * part.num_rows for c in ("prompt", image, ocr))
            out = [one(*row) for row in zip(*asked)]
            kinds = (("content", pa.string()), ("tokens_in", pa.int64()), ("tokens_out", pa.int64()), ("infer_error", pa.string()))
            got = [pa.array([o[i] for o in out], kind) for i, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns, *got], names=[*part.schema.names, *(c for c, _ in kinds)])


def ocr_rows(images: DataFrame, factory: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """image_path and tokens from (image_path, content binary) by a user-supplied recogniser, made once per partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = factory()
        for pdf in frames:
            rows = [recognise(bytes(c)) for c in pdf["content"]]
            if len(rows) != len(pdf):
                raise ValueError("a recogniser gives one result per image")
            yield pd.DataFrame({"image_path": pdf["image_path"], "tokens": rows})

    return images.select("image_path", "content").mapInPandas(run, "image_path string, tokens array<struct<text:string,confidence:double,text_region:array<array<double>>>>")


def ocr_normalize(raw: Column) -> Column:
    """Two recogniser outputs, {texts: [...], scores: [...], boxes: [...]} or [[box, [text, score]], ...], as one array of tokens."""
    wide = F.from_json(raw, "struct<texts:array<string>,scores:array<double>,boxes:array<array<array<double>>>>")
    zipped = F.arrays_zip(wide["texts"].alias("t"), wide["scores"].alias("s"), wide["boxes"].alias("b"))
    from_dict = F.transform(zipped, lambda z: F.struct(z["t"].alias("text"), z["s"].alias("confidence"), z["b"].alias("text_region")))
    items = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    from_list = F.transform(items, lambda v: F.struct(get(v, "$[1][0]", "string").alias("text"), get(v, "$[1][1]", "double").alias("confidence"), get(v, "$[0]", "array<array<double>>").alias("text_region")))
    return F.coalesce(F.when(wide["texts"].isNotNull(), from_dict), from_list, F.array().cast("array<struct<text:string,confidence:double,text_region:array<array<double>>>>"))


def filter_ocr_tokens(tokens: Column, least_confidence: float = 0.0, least_length: int = 1) -> Column:
    return F.filter(tokens, lambda t: (F.coalesce(t["confidence"], F.lit(0.0)) >= least_confidence) & (F.length(t["text"]) >= least_length))


class Rules:
    """Named row rules: each makes a boolean Column; null and false are invalid."""

    def __init__(self):
        self._rules: dict[str, tuple[Callable[[], Column], str]] = {}

    def register(self, name: str, make: Callable[[], Column], message: str) -> None:
        self._rules[name] = (make, message)

    def unregister(self, name: str) -> None:
        self._rules.pop(name, None)

    def names(self) -> list[str]:
        return list(self._rules)

    def get(self, name: str) -> Callable[[], Column] | None:
        return self._rules.get(name, (None,))[0]

    def results(self) -> Column:
        """array<struct<name, valid, message>>, the message null where the rule holds."""

        def one(name, make, message):
            ok = F.coalesce(make(), F.lit(False))
            return F.struct(F.lit(name).alias("name"), ok.alias("valid"), F.when(~ok, message).alias("message"))

        return F.array(*(one(n, m, t) for n, (m, t) in self._rules.items()))


def run_rules(df: DataFrame, rules: Rules) -> DataFrame:
    return df.withColumn("results", rules.results())


def dual_check(df: DataFrame, rules: Rules, verdict: str | None = "verdict") -> DataFrame:
    """Adds results, errors (``name: message``, and the verdict where it objects) and valid."""
    out = run_rules(df, rules)
    errors = F.transform(F.filter("results", lambda r: ~r["valid"]), lambda r: F.concat(r["name"], F.lit(": "), r["message"]))
    if verdict:
        low = F.lower(F.coalesce(F.col(verdict), F.lit("")))
        bad = F.lit(False)
        for w in OBJECTIONS:
            bad = bad | low.contains(w)
        errors = F.concat(errors, F.when(bad, F.array(F.col(verdict))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("errors", errors)
    return out.withColumn("valid", F.size("errors") == 0)


def self_correct(failed: DataFrame, factory: Callable[[], Client] = echo_client, attempts: int = 3, revalidate: Rules | None = None, partitions: int | None = CONCURRENCY) -> DataFrame:
    """Adds final_content, corrected and attempts to rows with prompt, content and errors.

    At most ``attempts`` passes over the rows that are still failing, each with
    the prompt improved by its errors. A row is corrected when its content has
    changed or, with ``revalidate``, when the rules hold for it. The answers of a
    pass are written, so that a model is asked once whatever reads them.
    """
    base = [c for c in failed.columns]
    open_ = failed.withColumns({"_original": F.col("content"), "_prompt": F.col("prompt")})
    done = None
    for k in range(1, attempts + 1):
        ask = open_.withColumns({"prompt": prompts.improved_prompt(F.col("_prompt"), F.col("errors")), "attempts": F.lit(k)})
        got = materialise(infer_rows(ask, factory, partitions).withColumn("_prompt", F.col("prompt")), "answers")
        fine = F.col("content").isNotNull() & (F.col("content") != "")
        if revalidate:
            got = dual_check(got, revalidate, None)
            fine = fine & F.col("valid")
        else:
            fine = fine & (F.col("content") != F.coalesce("_original", F.lit("")))
        part = got.withColumn("corrected", F.coalesce(fine, F.lit(False)))
        out = part if k == attempts else part.where("corrected")
        out = out.select(*(F.col("_original").alias("content") if c == "content" else F.col(c) for c in base if c not in ("prompt",)), "prompt", F.when(F.col("corrected"), F.col("content")).otherwise(F.col("_original")).alias("final_content"), "corrected", "attempts")
        done = out if done is None else done.unionByName(out)
        open_ = part.where("NOT corrected").drop("corrected", "attempts")
    return done


def govern_results(answers: DataFrame, rules: Rules, factory: Callable[[], Client] = echo_client, verdict: str | None = None, partitions: int | None = CONCURRENCY) -> DataFrame:
    """task_id, final_content, valid, corrected, attempts: checked answers as they are, failed ones corrected."""
    checked = dual_check(answers, rules, verdict)
    good = checked.where("valid").select("task_id", F.col("content").alias("final_content"), F.lit(True).alias("valid"), F.lit(False).alias("corrected"), F.lit(0).alias("attempts"))
    bad = self_correct(checked.where("NOT valid").select("task_id", "prompt", "content", "errors"), factory, partitions=partitions)
    return good.unionByName(bad.select("task_id", "final_content", F.lit(False).alias("valid"), "corrected", "attempts"))


STEPS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_step(name: str, step: Callable[[DataFrame], DataFrame]) -> None:
    STEPS[name] = step


def run_steps(df: DataFrame, names: list[str], steps: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    for name in names:
        df = df.transform((steps or STEPS)[name])
    return df
