"""Persistent paper filters: validated definitions that compile to Catalyst columns.

A status is a nullable boolean while it is computed: included is true, excluded
false and unavailable null. SQL's three-valued AND and OR then combine filters,
and a stack is one expression, folded from left to right.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import all_of, any_of, has_value
from ..functions.textops import trim_references

#: Fields that a regex filter can read, and its evidence caps.
FIELDS = ("title", "abstract", "full_text")
MAX_MATCHES, MAX_SNIPPETS = 1000, 3
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")
#: A repeated group that repeats or branches within, or a reference back: a backtracking matcher may take exponential time.
_BACKTRACKS = re.compile(r"\((?:[^()\\]|\\.)*[+*}|](?:[^()\\]|\\.)*\)[+*{]|\\[1-9]|\(\?P=")


def _check(ok: object, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _unique(rules: tuple) -> None:
    names = [r.name for r in rules]
    _check(len(names) == len(set(names)), "rule names must be unique")
    _check(all(_NAME.fullmatch(n) for n in names), "rule names must be plain words")


@dataclass(frozen=True)
class Pattern:
    name: str
    pattern: str


@dataclass(frozen=True)
class RegexFilter:
    name: str
    include: tuple[Pattern, ...]
    exclude: tuple[Pattern, ...] = ()
    fields: tuple[str, ...] = ("title",)
    include_mode: str = "any"
    case_sensitive: bool = False
    timeout_ms: int = 500
    description: str = ""

    def __post_init__(self):
        _check(_NAME.fullmatch(self.name), f"not a filter name: {self.name!r}")
        _check(self.include, "a filter needs a rule to include by")
        _check(self.fields and set(self.fields) <= set(FIELDS), f"fields must be some of {', '.join(FIELDS)}")
        _check(self.include_mode in ("any", "all"), "include_mode must be any or all")
        _check(self.timeout_ms > 0, "timeout_ms must be positive")
        _unique(self.include + self.exclude)
        for rule in self.include + self.exclude:
            try:
                re.compile(rule.pattern)
            except re.error as e:
                raise ValueError(f"{rule.name}: {e}") from e

    @classmethod
    def from_json(cls, text: str) -> RegexFilter:
        raw = json.loads(text)
        rules = {k: tuple(Pattern(**r) for r in raw.pop(k, [])) for k in ("include", "exclude")}
        return cls(**{**raw, "fields": tuple(raw.get("fields", ("title",)))}, **rules)

    def java(self, rule: Pattern) -> str:
        return ("(?U)" if self.case_sensitive else "(?iU)") + rule.pattern

    def matched(self, rule: Pattern) -> Column:
        """Whether any present field matches; never null."""
        return any_of([F.coalesce(F.col(f).rlike(self.java(rule)), F.lit(False)) for f in self.fields])

    @property
    def backtracks(self) -> bool:
        """Whether a pattern has a form on which matching may not end in time."""
        return any(_BACKTRACKS.search(r.pattern) for r in self.include + self.exclude)

    def status(self) -> Column:
        """True, false or null: included, excluded, unavailable.

        Patterns that may backtrack without end are matched under the time
        limit (:meth:`bounded_status`), all others within the plan.
        """
        if self.backtracks:
            return self.bounded_status()
        vetoed = any_of([self.matched(r) for r in self.exclude])
        includes = [self.matched(r) for r in self.include]
        wanted = any_of(includes) if self.include_mode == "any" else all_of(includes)
        missing = any_of([~has_value(f) for f in self.fields])
        return F.when(vetoed, F.lit(False)).when(wanted, F.lit(True)).when(missing, F.lit(None).cast("boolean")).otherwise(F.lit(False))

    def bounded_status(self) -> Column:
        """:meth:`status` by the ``regex`` engine, which gives a pattern up after ``timeout_ms`` in a field.

        A paper is unavailable if a pattern was given up, unless what did match
        decides it: an exclusion, or all that the inclusion needs.
        """
        import pyarrow as pa

        rules, insensitive, limit, mode = {"include": [r.pattern for r in self.include], "exclude": [r.pattern for r in self.exclude]}, not self.case_sensitive, self.timeout_ms / 1000, self.include_mode

        def judge(values: pa.Array) -> pa.Array:
            import regex

            compiled = {kind: [regex.compile(p, regex.V1 | (regex.IGNORECASE if insensitive else 0)) for p in found] for kind, found in rules.items()}

            def of(texts: list) -> bool | None:
                late = any(not (t or "").strip() for t in texts)

                def hit(pattern) -> bool:
                    nonlocal late
                    for text in texts:
                        try:
                            if text and pattern.search(text, timeout=limit):
                                return True
                        except TimeoutError:
                            late = True
                    return False

                if any([hit(p) for p in compiled["exclude"]]):
                    return False
                found = [hit(p) for p in compiled["include"]]
                return True if (any if mode == "any" else all)(found) else None if late else False

            return pa.array([of(texts) for texts in values.to_pylist()], pa.bool_())

        judge.__annotations__ = {"values": pa.Array, "return": pa.Array}
        return F.arrow_udf(judge, "boolean")(F.array(*(F.col(f).cast("string") for f in self.fields)))

    def counts(self) -> list[Column]:
        """Matches per rule and field, up to the cap, as ``<rule>__<field>``."""
        return [F.least(F.regexp_count(F.coalesce(F.col(f), F.lit("")), F.lit(self.java(r))), F.lit(MAX_MATCHES)).alias(f"{r.name}__{f}") for r in self.include + self.exclude for f in self.fields]

    def evidence(self, rows: DataFrame, key: str = "paper_id") -> DataFrame:
        """Matches, snippets and time-outs per rule and field, by the ``regex`` engine, which can give up.

        Returns ``key, rule_type, rule, field, n, truncated, snippets, timed_out``.
        """
        import pyarrow as pa

        rules, flags, limit, fields = [("include", r) for r in self.include] + [("exclude", r) for r in self.exclude], not self.case_sensitive, self.timeout_ms / 1000, self.fields
        kind = rows.schema[key].dataType.simpleString()

        def find(batches):
            import regex

            compiled = [(t, r.name, regex.compile(r.pattern, regex.V1 | (regex.IGNORECASE if flags else 0))) for t, r in rules]
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    for rule_type, name, pattern in compiled:
                        for f in fields:
                            text, n, found, late = row[f] or "", 0, [], False
                            try:
                                for m in pattern.finditer(text, timeout=limit):
                                    n += 1
                                    if n <= MAX_SNIPPETS:
                                        found.append(" ".join(text[max(0, m.start() - 80) : m.end() + 80].split()))
                                    if n == MAX_MATCHES:
                                        break
                            except TimeoutError:
                                late = True
                            if n or late:
                                out.append({key: row[key], "rule_type": rule_type, "rule": name, "field": f, "n": n, "truncated": n == MAX_MATCHES, "snippets": found, "timed_out": late})
                schema = pa.schema([(key, batch.schema.field(key).type), ("rule_type", pa.string()), ("rule", pa.string()), ("field", pa.string()), ("n", pa.int32()), ("truncated", pa.bool_()), ("snippets", pa.list_(pa.string())), ("timed_out", pa.bool_())])
                yield pa.RecordBatch.from_pylist(out, schema)

        return rows.select(key, *fields).mapInArrow(find, f"{key} {kind}, rule_type string, rule string, field string, n int, truncated boolean, snippets array<string>, timed_out boolean")


@dataclass(frozen=True)
class TopicRule:
    name: str
    topic_id: int
    min_probability: float | None = None
    require_dominant: bool = False

    def __post_init__(self):
        _check(self.min_probability is not None or self.require_dominant, f"{self.name}: give a threshold or require dominance")
        _check(self.min_probability is None or 0 <= self.min_probability <= 1, f"{self.name}: the threshold must be from 0 to 1")


@dataclass(frozen=True)
class TopicFilter:
    """Reads ``scores map<int, double>``, ``dominant_topic`` and ``prediction_status``."""

    name: str
    model: str
    include: tuple[TopicRule, ...]
    exclude: tuple[TopicRule, ...] = ()
    include_mode: str = "any"

    def __post_init__(self):
        _check(_NAME.fullmatch(self.name), f"not a filter name: {self.name!r}")
        _check(self.include, "a filter needs a rule to include by")
        _check(self.include_mode in ("any", "all"), "include_mode must be any or all")
        _unique(self.include + self.exclude)

    def validate(self, topics: int) -> None:
        _check(all(0 <= r.topic_id < topics for r in self.include + self.exclude), f"topics run from 0 to {topics - 1}")

    @staticmethod
    def matched(rule: TopicRule) -> Column:
        parts = []
        if rule.min_probability is not None:
            parts.append(F.element_at("scores", F.lit(rule.topic_id)) >= rule.min_probability)
        if rule.require_dominant:
            parts.append(F.col("dominant_topic") == rule.topic_id)
        return all_of(parts)

    def status(self) -> Column:
        needed = F.array(*(F.lit(t) for t in sorted({r.topic_id for r in self.include + self.exclude})))
        usable = (F.col("prediction_status") == "predicted") & F.forall(needed, lambda t: F.map_contains_key("scores", t))
        includes = [self.matched(r) for r in self.include]
        wanted = any_of(includes) if self.include_mode == "any" else all_of(includes)
        verdict = F.when(any_of([self.matched(r) for r in self.exclude]), F.lit(False)).otherwise(wanted)
        return F.when(F.coalesce(usable, F.lit(False)), verdict)


def status_name(status: Column) -> Column:
    return F.when(status, "included").when(~status, "excluded").otherwise("unavailable")


def status_value(name: Column) -> Column:
    """The nullable boolean of a status' name; any other name is unavailable."""
    return F.when(name == "included", F.lit(True)).when(name == "excluded", F.lit(False))


def combine(left: Column, op: str, right: Column) -> Column:
    _check(op in ("and", "or"), f"unknown operation {op!r}")
    return left & right if op == "and" else left | right


@dataclass(frozen=True)
class Step:
    filter: RegexFilter | TopicFilter
    op: str | None = None  # None only for the first


@dataclass(frozen=True)
class FilterStack:
    """Ordered filters; all changes return a new stack."""

    steps: tuple[Step, ...] = field(default=())

    def apply(self, added: RegexFilter | TopicFilter, op: str | None = None, *, override: bool = False) -> FilterStack:
        """Append a filter, or replace the one of its name; ``and`` joins by default."""
        names = [s.filter.name for s in self.steps]
        if added.name in names:
            _check(override, f"filter {added.name} exists")
            return FilterStack(tuple(replace(s, filter=added, op=op or s.op if k else None) if s.filter.name == added.name else s for k, s in enumerate(self.steps)))
        _check(self.steps or op is None, "the first filter joins nothing")
        _check(op in (None, "and", "or"), f"unknown operation {op!r}")
        return FilterStack((*self.steps, Step(added, (op or "and") if self.steps else None)))

    def reset(self, name: str | None = None) -> FilterStack:
        """Without one filter, or without any; what comes first then joins nothing."""
        if name is None:
            return FilterStack()
        _check(any(s.filter.name == name for s in self.steps), f"no filter {name}")
        left = [s for s in self.steps if s.filter.name != name]
        return FilterStack(tuple(replace(s, op=(s.op or "and") if k else None) for k, s in enumerate(left)))

    def expression(self) -> str:
        """Like ``((a OR b) AND c)``."""
        if not self.steps:
            return ""
        return reduce(lambda text, s: f"({text} {s.op.upper()} {s.filter.name})", self.steps[1:], self.steps[0].filter.name)

    def fold(self, status_of: Callable[[Step], Column]) -> Column:
        if not self.steps:
            return F.lit(True)
        return reduce(lambda acc, s: combine(acc, s.op, status_of(s)), self.steps[1:], status_of(self.steps[0]))

    def evaluate(self, rows: DataFrame) -> DataFrame:
        """Add a status column per filter, named like it, and ``final_status``, in one projection."""
        each = {s.filter.name: status_name(s.filter.status()) for s in self.steps}
        return rows.withColumns({**each, "final_status": status_name(self.fold(lambda s: s.filter.status()))})

    def recompute(self, papers: DataFrame, results: DataFrame) -> DataFrame:
        """Fold stored results ``(filter, paper_id, status)``; a missing one is unavailable."""
        names = [s.filter.name for s in self.steps]
        wide = results.where(F.col("filter").isin(names)).groupBy("paper_id").pivot("filter", names).agg(F.first("status"))
        joined = papers.join(wide, "paper_id", "left")
        return joined.withColumn("final_status", status_name(self.fold(lambda s: status_value(F.col(f"`{s.filter.name}`")))))


    def apply_stored(self, added: RegexFilter | TopicFilter, papers: DataFrame, results: DataFrame | None, op: str | None = None, *, override: bool = False, key: str = "paper_id") -> tuple[FilterStack, DataFrame]:
        """The stack with a filter and its results ``(filter, paper_id, status)`` stored beside those of the others."""
        stack = self.apply(added, op, override=override)
        fresh = papers.select(F.lit(added.name).alias("filter"), F.col(key).alias("paper_id"), status_name(added.status()).alias("status"))
        return stack, fresh if results is None else results.where(F.col("filter") != added.name).unionByName(fresh)

    def reset_stored(self, results: DataFrame, name: str | None = None) -> tuple[FilterStack, DataFrame]:
        """Without one filter and its results, or without any."""
        return self.reset(name), results.where(F.lit(False)) if name is None else results.where(F.col("filter") != name)

    def refresh_topics(self, papers: DataFrame, results: DataFrame, model: str, key: str = "paper_id") -> DataFrame:
        """Results with those of the topic filters of ``model`` computed again, from ``papers`` with its new scores."""
        ours = [s.filter for s in self.steps if isinstance(s.filter, TopicFilter) and s.filter.model == model]
        out = results.where(~F.col("filter").isin([f.name for f in ours])) if ours else results
        for f in ours:
            out = out.unionByName(papers.select(F.lit(f.name).alias("filter"), F.col(key).alias("paper_id"), status_name(f.status()).alias("status")))
        return out

    def to_json(self) -> str:
        """The definition of the stack, which :meth:`from_json` reads."""
        return json.dumps([{"kind": "regex" if isinstance(s.filter, RegexFilter) else "topic", "op": s.op, "filter": asdict(s.filter)} for s in self.steps], ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> FilterStack:
        steps = []
        for raw in json.loads(text):
            kind, rule = (RegexFilter, Pattern) if raw["kind"] == "regex" else (TopicFilter, TopicRule)
            fields = {k: tuple(rule(**r) for r in v) if k in ("include", "exclude") else tuple(v) if isinstance(v, list) else v for k, v in raw["filter"].items()}
            steps.append(Step(kind(**fields), raw["op"]))
        return cls(tuple(steps))


def overview(evaluated: DataFrame, names: list[str]) -> DataFrame:
    """``filter, included, excluded, unavailable`` for each filter and the final status, in one pass."""
    rows = evaluated.select(F.explode(F.array(*(F.struct(F.lit(n).alias("filter"), F.col(f"`{n}`").alias("status")) for n in [*names, "final_status"]))).alias("r")).select("r.*")
    return rows.groupBy("filter").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("included", "excluded", "unavailable")))


def paper_content(papers: DataFrame, assets: DataFrame, key: str = "paper_id") -> DataFrame:
    """Add ``abstract``, ``full_text`` (the text asset without its references, else the PDF's text) and ``unavailable``, the fields that are missing.

    ``assets`` has one row per paper and role, with ``content`` as text.
    """
    wide = assets.groupBy(key).pivot("role", ["abstract", "text", "pdf"]).agg(F.first("content"))
    both = papers.drop("abstract", "full_text").join(wide.withColumnRenamed("abstract", "__abstract"), key, "left")
    whole = F.when(has_value("text"), trim_references("text")).otherwise(F.coalesce("pdf", F.lit("")))
    both = both.withColumn("abstract", F.coalesce("__abstract", F.lit(""))).withColumn("full_text", whole).drop("__abstract", "text", "pdf")
    return both.withColumn("unavailable", F.array_compact(F.array(*(F.when(~has_value(f), F.lit(f)) for f in FIELDS))))


def gate(papers: DataFrame, evaluated: DataFrame, *, ignore_filters: bool = False) -> DataFrame:
    """Papers whose final status is included."""
    return papers if ignore_filters else papers.join(evaluated.where("final_status = 'included'").select("paper_id"), "paper_id", "left_semi")


def fingerprint(rows: DataFrame, key: str = "paper_id", text: str = "full_text") -> str:
    """A hash of all ids and texts; equal corpora have equal hashes.

    Rows hash alone; sums of the hashes' parts, with the count, make one value
    without a sort, and without gathering rows anywhere.
    """
    h = F.sha2(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\0"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(8)]
    row = rows.agg(F.count("*").alias("n"), *parts).first()
    import hashlib

    return hashlib.sha256(repr([str(v or 0) for v in row]).encode()).hexdigest()


def current(stored_fingerprint: str, rows: DataFrame, **columns: str) -> None:
    """Fail unless stored scores belong to just this corpus."""
    _check(stored_fingerprint == fingerprint(rows, **columns), "the corpus has changed since the scores were stored")
