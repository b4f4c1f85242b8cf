"""Structured records from texts: recipes, prompts, chunks, model calls, repair and storage.

Models are callables that executors call with a prompt; none ships with the
library. A failing call marks its chunk, and only the chunks that succeeded
give records.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import has_value
from ..functions.textops import equal_chunks, estimated_tokens, json_records, token_budget, token_reserve

#: Columns that say where a record comes from.
PROVENANCE = ("Paper id", "doi", "Publication date", "Source", "Source path")


@dataclass(frozen=True)
class RecipeField:
    name: str
    prompt: str
    example: str = ""
    unit: str = ""
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Recipe:
    subject: str
    singular: str
    plural: str
    unit: str
    identity: tuple[str, ...]
    fields: tuple[RecipeField, ...]
    prompts: tuple[str, ...] = field(default=())

    @classmethod
    def from_json(cls, text: str, name: str | None = None) -> Recipe:
        """One recipe, or the one called ``name`` of several."""
        raw = json.loads(text)
        if "search fields" not in raw:
            if name is None and len(raw) == 1:
                name = next(iter(raw))
            if name not in raw:
                raise ValueError(f"no recipe {name!r}; there are: {', '.join(raw)}")
            raw = raw[name]
        head = raw.get("record definition")
        if not isinstance(head, dict) or not raw.get("search fields"):
            raise ValueError("a recipe has a record definition and search fields")
        fields = []
        for n, f in raw["search fields"].items():
            if not f.get("prompt"):
                raise ValueError(f"{n} has no prompt")
            if n in PROVENANCE:
                raise ValueError(f"{n} is a provenance column")
            fields.append(RecipeField(n, f["prompt"], str(f.get("example", "")), f.get("unit", ""), tuple(f.get("aliases", ()))))
        identity = tuple(head.get("identity fields", ()))
        if not identity or not set(identity) <= {f.name for f in fields}:
            raise ValueError("identity fields must be search fields")
        extra = raw.get("additional prompts", ())
        return cls(head["subject"], head["singular"], head["plural"], head.get("unit", ""), identity, tuple(fields), (extra,) if isinstance(extra, str) else tuple(extra))

    def prompt(self) -> str:
        lines = [f"Read the text on {self.subject} and list every {self.singular}.", "Fields of a record:"]
        lines += [f"- {f.name}{f' [{f.unit}]' if f.unit else ''}: {f.prompt}" for f in self.fields]
        lines += list(self.prompts)
        lines.append("Example: " + json.dumps([{f.name: f.example for f in self.fields}], ensure_ascii=False))
        lines.append(f"Answer with a JSON list of {self.plural}, null where a value isn't given, [] if there are none.")
        return "\n".join(lines)

    def schema(self) -> str:
        return ", ".join(f"`{n}` string" for n in [*(f.name for f in self.fields), *PROVENANCE])

    def column_for(self, header: str) -> str | None:
        """The field that a result column means: by name, alias or prompt, with or without its unit."""

        def key(text: str) -> str:
            return "".join(c for c in text.casefold() if c.isalnum())

        for f in self.fields:
            names = {f.name, f.prompt, *f.aliases}
            if key(header) in {key(n) for n in names} | {key(f"{n} {f.unit}") for n in names if f.unit}:
                return f.name
        return None


def chunk_plan(texts: DataFrame, *, limit: int = 32_000, prompt: str = "", tokens: Column | None = None, text: str = "full_text") -> DataFrame:
    """``chunks`` (equal slices within the token budget) and ``n_chunks`` for every row."""
    budget = token_budget(limit, token_reserve(-(-len(prompt) // 3)))
    count = estimated_tokens(text) if tokens is None else tokens
    return texts.withColumn("n_tokens", count).withColumn("chunks", F.when(has_value(text), equal_chunks(text, F.col("n_tokens"), budget))).withColumn("n_chunks", F.coalesce(F.size("chunks"), F.lit(0)))


def ask_model(chunks: DataFrame, recipe: Recipe, model: Callable[[str], str], *, key: str = "paper_id") -> DataFrame:
    """``key, chunk_no, records array<map<string,string>>, status, error``: one call per chunk, on executors."""
    prompt = recipe.prompt()
    rows = chunks.select(key, F.posexplode("chunks").alias("chunk_no", "chunk"))
    names = [f.name for f in recipe.fields]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, n, chunk in zip(batch[key], batch["chunk_no"], batch["chunk"]):
                try:
                    found = json_records(model(f"{prompt}\n\n{chunk}"))
                    if found is None:
                        raise ValueError("the answer holds no JSON records")
                    records = [{f: None if r.get(f) is None else str(r[f]) for f in names} for r in found]
                    out.append((k, n, records, "succeeded", ""))
                except Exception as e:  # a call may fail in any way; the chunk says how
                    out.append((k, n, [], "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "chunk_no", "records", "status", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInPandas(call, f"{key} {kind}, chunk_no int, records array<map<string,string>>, status string, error string")


def records_with_provenance(answers: DataFrame, papers: DataFrame, recipe: Recipe, *, source: str = "text", key: str = "paper_id") -> DataFrame:
    """One row per record, with the recipe's columns and where it comes from."""
    about = papers.select(F.col(key), *(F.col(c) if c in papers.columns else F.lit("").alias(c) for c in ("doi", "publication_date", "text_path")))
    rows = answers.select(key, F.explode("records").alias("r")).join(about, key)
    fields = [F.element_at("r", F.lit(f.name)).alias(f.name) for f in recipe.fields]
    return rows.select(*fields, F.col(key).cast("string").alias(PROVENANCE[0]), F.col("doi").alias(PROVENANCE[1]), F.col("publication_date").alias(PROVENANCE[2]), F.lit(source).alias(PROVENANCE[3]), F.col("text_path").alias(PROVENANCE[4]))


def paper_status(answers: DataFrame, key: str = "paper_id") -> DataFrame:
    """Per paper: succeeded if all chunks did, else failed, with the errors and the number of records."""
    return answers.groupBy(key).agg(
        F.when(F.bool_and(F.col("status") == "succeeded"), "succeeded").otherwise("failed").alias("status"), F.array_join(F.array_sort(F.collect_set(F.nullif("error", F.lit("")))), "; ").alias("last_error"),
        F.sum(F.size("records")).alias("num_text_materials"),
    )


def reconcile(text_records: DataFrame, image_records: DataFrame, recipe: Recipe, merge: Callable[[list[dict], list[dict]], list[dict]] | None = None, *, key: str = "Paper id") -> DataFrame:
    """Records of both sources per paper; without ``merge``, or where it fails, one after the other."""
    both = text_records.unionByName(image_records, allowMissingColumns=True)
    if merge is None:
        return both

    def of_paper(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [rows[rows["Source"] == s].to_dict("records") for s in ("text", "image")]
        try:
            return pd.DataFrame(merge(*parts), columns=rows.columns)
        except Exception:
            return rows

    return both.groupBy(key).applyInPandas(of_paper, both.schema)


def canonical_columns(results: DataFrame, recipe: Recipe) -> DataFrame:
    """Result columns under the recipe's names; unknown ones are dropped, provenance is kept."""
    out, seen = [], set()
    for c in results.columns:
        name = c if c in PROVENANCE else recipe.column_for(c)
        if name and name not in seen:
            out.append(F.col(f"`{c}`").cast("string").alias(name))
            seen.add(name)
    return results.select(*out)


#: Factor and offset that turn a unit into the one it is listed under.
UNITS = {"K": {"K": (1.0, 0.0), "C": (1.0, 273.15), "F": (5 / 9, 459.67 * 5 / 9)}, "eV": {"eV": (1.0, 0.0), "meV": (1e-3, 0.0), "J": (6.241509074e18, 0.0)}, "Pa": {"Pa": (1.0, 0.0), "kPa": (1e3, 0.0), "MPa": (1e6, 0.0), "GPa": (1e9, 0.0), "bar": (1e5, 0.0)}, "m": {"m": (1.0, 0.0), "cm": (1e-2, 0.0), "mm": (1e-3, 0.0), "um": (1e-6, 0.0), "nm": (1e-9, 0.0)}}


def convert_units(value: Column, unit: Column, target: str) -> Column:
    """A number in the target unit, or null for a missing value or an unknown unit."""
    if target not in UNITS:
        raise ValueError(f"units are known for {', '.join(UNITS)}")
    number = F.regexp_extract(value, r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", 0).try_cast("double")
    out = F.lit(None).cast("double")
    for name, (factor, offset) in UNITS[target].items():
        out = F.when(unit == name, number * factor + offset).otherwise(out)
    return out


def store_results(stored: DataFrame | None, results: list[DataFrame], recipe: Recipe) -> DataFrame:
    """All results under the recipe's columns, with what is stored, without repeated rows."""
    frames = [canonical_columns(r, recipe) for r in results]
    out = stored if stored is not None else frames.pop(0)
    for f in frames:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.dropDuplicates()


def _file_system(spark, path: str):
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return Path, Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_swapped(rows: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Write beside ``path``, move the old table aside, move the new one in, then delete the old one.

    The old table is whole until the new one is. A crash between the two moves
    leaves no table at ``path``, but both beside it; :func:`recover_swap`, which
    this function calls first, puts the old one back.
    """
    spark = rows.sparkSession
    recover_swap(spark, path)
    Path, fs = _file_system(spark, path)
    fs.delete(Path(f"{path}.new"), True)
    rows.write.format(fmt).options(**options).save(f"{path}.new")
    old = fs.exists(Path(path))
    if old and not fs.rename(Path(path), Path(f"{path}.old")):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(Path(f"{path}.new"), Path(path)):
        if old:
            fs.rename(Path(f"{path}.old"), Path(path))
        raise OSError(f"{path}.new can't be moved")
    fs.delete(Path(f"{path}.old"), True)


def recover_swap(spark, path: str) -> None:
    """After a crash within :func:`write_swapped`: the old table back in place, or deleted where the new one is."""
    Path, fs = _file_system(spark, path)
    if fs.exists(Path(f"{path}.old")):
        if fs.exists(Path(path)):
            fs.delete(Path(f"{path}.old"), True)
        else:
            fs.rename(Path(f"{path}.old"), Path(path))


def append_csv(rows: DataFrame, path: str) -> None:
    """Append records to a CSV table; columns are those of both, missing values empty."""
    spark = rows.sparkSession
    Path, fs = _file_system(spark, path)
    recover_swap(spark, path)
    both = read_csv(spark, path).unionByName(rows.select([F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns]), allowMissingColumns=True) if fs.exists(Path(path)) else rows
    write_swapped(both, path, "csv", header="true", escape='"', multiLine="true")


def read_csv(spark, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header and quoted line breaks; all columns are texts without a schema."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)
