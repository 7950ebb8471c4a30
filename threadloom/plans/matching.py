"""Word matching over ``documents`` and ``conversations``; beyond SQL, so tested
against the sequential rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text
from threadloom.operators import matching
from threadloom.plans import query, table


def captures(spark, sf_dir):
    """Conversation lines as captures, whole: (id, quote, members)."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("quote"), F.array(F.col("conv_id") * 10 + F.floor(F.col("turn") / 3)).alias("members"))


@query()
def quote_pairs(spark, sf_dir):
    """Scores of each line with the one before it in its conversation."""
    before = F.lag("quote").over(Window.partitionBy(F.floor(F.col("id") / 100)).orderBy("id"))
    pairs = captures(spark, sf_dir).select("id", "quote", before.alias("earlier")).where("earlier IS NOT NULL")
    return pairs.select("id", F.round(text.quote_score("earlier", "quote"), 6).alias("score"))


@query()
def carry_match(spark, sf_dir):
    """Greedy one-to-one within components."""
    c = captures(spark, sf_dir)
    return matching.carry_verdicts(c.where("id % 2 = 0"), c.where("id % 2 = 1"), least=0.1)


@query()
def observations(spark, sf_dir):
    """K2."""
    return matching.assign_observations(captures(spark, sf_dir), least=0.15)


def stitched(line: str) -> str:
    """A quote of a whole line, with a leaked label and without its middle word."""
    w = line.split()
    return "[1] me: " + " ".join(w[: len(w) // 2]) + " ... " + " ".join(w[len(w) // 2 + 1 :])


@query()
def quote_place(spark, sf_dir):
    """Where a stitched quote of each line stands in its conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    window = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("w"))

    @F.pandas_udf("array<struct<turn:long,lines:string,share:double>>")
    def placed(windows: pd.Series) -> pd.Series:
        out = []
        for rows in windows:
            lines = [(str(x["turn"]), x["text"]) for x in rows]
            got = ((int(n), *text.place(stitched(t), lines, [n])[1:]) for n, t in lines)
            out.append([{"turn": n, "lines": ",".join(on), "share": share} for n, on, share in got])
        return pd.Series(out)

    return window.select("conv_id", F.explode(placed("w")).alias("p")).select("conv_id", "p.turn", "p.lines", "p.share")


def made_capture(conv: int, lines: list[tuple[int, str, str]]) -> tuple:
    """The arguments of a capture of a conversation: right or wrong in one way."""
    first, last = lines[0][2], lines[-1][2]
    quote = [first, first.upper(), last, first + " " + (lines[1][2] if len(lines) > 1 else ""), "nobody said this", ""][conv % 6]
    heard = first.split()[:1] if conv % 4 == 0 else ["unheard"] if conv % 4 == 1 else []
    return quote, [1] if conv % 5 else [2], "a reading" if conv % 7 else "", "a gist" if conv % 9 else " ", [(h, "reading") for h in heard]


@query()
def capture_checks(spark, sf_dir):
    """Codes of what is wrong with a capture of each conversation."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    lines = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))

    @F.pandas_udf("string")
    def checked(conv: pd.Series, l: pd.Series) -> pd.Series:  # noqa: E741
        out = []
        for n, rows in zip(conv, l):
            numbered = [(i + 1, "me" if x["role"] == "user" else "S1", x["text"]) for i, x in enumerate(rows)]
            out.append(",".join(matching.check_capture(numbered, *made_capture(n, numbered))))
        return pd.Series(out)

    return lines.select("conv_id", checked("conv_id", "l").alias("codes"))
