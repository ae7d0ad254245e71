"""Writers: JSON lines by split and language, versions that replace one another, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_by(df: DataFrame, path: str, *columns: str) -> None:
    """JSON lines in a folder for each value of the columns; values without rows get none."""
    df.write.mode("overwrite").partitionBy(*columns).option("ignoreNullFields", "true").json(path)


def new_version(df: DataFrame, root: str) -> str:
    """Write the rows as the next version below root and return its path; a version is listed only once it is complete."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    have = [int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.getPath().getName()[1:].isdigit()] if fs.exists(path) else []
    out = f"{root}/v{max(have, default=0) + 1}"
    df.write.parquet(out)
    return out


def latest_version(spark, root: str) -> DataFrame | None:
    """The newest complete version below root."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return None
    done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.getPath().getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{root}/v{max(done)}") if done else None


def predictions(df: DataFrame, path: str) -> None:
    """question, difficulty, the true and the predicted label's names, and whether they agree, as JSON lines."""
    names = F.array(F.lit("EASY"), F.lit("MEDIUM"), F.lit("HARD"))
    df.select("question", "difficulty", F.get(names, F.col("truth")).alias("true_label"), F.get(names, F.col("pred")).alias("pred_label"), (F.col("truth") == F.col("pred")).alias("correct")).write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A table of a report, with bars escaped. For results of a few rows: more than `most` raise an error rather than being cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    show = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows]) + "\n"


def json_report(parts: dict[str, DataFrame], most: int = 1000) -> str:
    """The rows of each part as one JSON object; more than `most` rows in a part raise an error rather than being cut."""
    out = {}
    for name, df in parts.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} rows are no report")
        out[name] = [r.asDict(recursive=True) for r in rows]
    return json.dumps(out, ensure_ascii=False, indent=2, default=str)


def console_table(df: DataFrame, form: str = "%.3f", most: int = 1000) -> str:
    """The rows as columns of equal width, numbers to the right; for results of a few rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    show = lambda v: "-" if v is None else form % v if isinstance(v, float) else str(v)
    cells = [list(df.columns), *[[show(v) for v in r] for r in rows]]
    widths = [max(len(c[i]) for c in cells) for i in range(len(df.columns))]
    right = [any(isinstance(r[i], (int, float)) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(line, widths, right)).rstrip() for line in cells) + "\n"


def highlighted(text: Column, part: Column, mark: str = "**") -> Column:
    """The text with the first occurrence of a part between marks; bars escaped. The text as it is where it lacks the part."""
    at = F.instr(text, part)
    rest = F.substring(text, at + F.length(part), F.lit(1 << 30))
    marked = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(mark), part, F.lit(mark), rest)
    return F.replace(F.when((at > 0) & (part != ""), marked).otherwise(text), F.lit("|"), F.lit("\\|"))


def question_report(text: str, lang: str, questions: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 1000) -> str:
    """The Markdown report of one document: its sentences, its questions with level and scores, answers of several events, and its graph, nodes
    and edges in order. questions: kind, text, answer, level, s_type, s_local, s_vocab, s_read, answer_list; nodes: node,
    entity_type; edges: src, relation, dst."""
    esc = lambda v: "" if v is None else str(v).replace("|", "\\|")
    rows = questions.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} questions are no report")
    out = ["# Question report", "", f"Language: {lang}", f"Questions: {len(rows)}", "", "## Text", "", *[s for s in (x.strip() for x in text.split(". ")) if s], "", "## Questions", ""]
    out += ["| Kind | Level | s_type | s_local | s_vocab | s_read | Question | Answer |", "|" + " --- |" * 8]
    events = []
    for r in rows:
        answer = r["answer"]
        if r["answer_list"] and "subgraph" in r["kind"] and len(r["answer_list"]) > 1:
            events.append(r)
            answer = f"({len(r['answer_list'])} events, see below)"
        elif r["answer_list"]:
            answer = " / ".join(r["answer_list"])
        scores = " | ".join(f"{r[c]:.2f}" for c in ("s_type", "s_local", "s_vocab", "s_read"))
        out.append(f"| {r['kind']} | {r['level']} | {scores} | {esc(r['text'])} | {esc(answer)} |")
    for r in events:
        out += ["", f"### {r['text']}", "", *[f"{i}. {x}" for i, x in enumerate(r["answer_list"], 1)]]
    tables = [(nodes.select("node", "entity_type").orderBy("node"), "Nodes"), (edges.select("src", "relation", "dst").orderBy("src", "relation", "dst"), "Edges")]
    return "\n".join([*out, ""]) + "".join("\n" + markdown(t, name, most) for t, name in tables)
