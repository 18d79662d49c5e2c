"""Files and names: checks against a manifest, free names, labels, choices."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import work_dir, written
from .prefix import numbered, running


def verify_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """status of each file of the manifest: missing, too_small(n), sha256_mismatch or ok."""
    seen = files.select("name", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("have"))
    rows = manifest.join(seen, "name", "left")
    wrong = (F.length("sha256") > 0) & (F.lower("sha256") != F.col("have"))
    status = F.when(F.col("size").isNull(), "missing").when(F.col("size") < F.col("min_bytes"), F.format_string("too_small(%d)", "size")).when(wrong, "sha256_mismatch").otherwise("ok")
    return rows.select("name", status.alias("status"))


#: stem, number and ending of a name that looks like a numbered form; forms have no leading zero.
_FORM = r"(?s)^(.*)\(([1-9][0-9]{0,17})\)(\.[^./]*)?$"
#: stem and ending; a dot that a file name starts with starts no ending.
_PARTS = r"(?s)^((?:.*/)?\.*[^./][^/]*?)(\.[^./]*)?$"


def _origin(name: str) -> tuple[Column, Column]:
    """The name that a form is numbered from, and its number; null for a name that is no form."""
    number = F.regexp_extract(name, _FORM, 2)
    base = F.concat(F.regexp_extract(name, _FORM, 1), F.regexp_extract(name, _FORM, 3))
    is_form = (number != "") & (F.regexp_extract(base, _PARTS, 2) == F.regexp_extract(name, _FORM, 3))
    return F.when(is_form, base), F.when(is_form, number.cast("long"))


def allocate_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """out_name of each wanted (seq, name): in the order of seq, each takes the first of name, name(1), name(2)... that neither exists nor was taken before it; the extension stays last. seq is unique; rows without a name get none.

    A form can be wanted by two names only: as itself, and as a numbered form of its origin. As itself it goes to the first who
    asks for it, if it is free then. So names are settled by depth, origins before their forms. Within one name, a form that
    others ask for by name is passed over if that happened before the turn comes to it; whether it did depends on
    how many forms were passed over before: proposals of which forms are passed over are counted and resolved until none changes.
    All numbers are running counts within a name, in two levels, so a name may have any number of requests and forms.
    """
    path = work_dir(wanted.sparkSession)
    base, number = _origin("name")
    asked = written(numbered(wanted.where("name IS NOT NULL").select("seq", "name"), "name", ["seq"]), f"{path}/asked")
    firsts = asked.where("k = 1").select("name", F.col("seq").alias("first"))
    taken = existing.where("name IS NOT NULL").select("name").distinct().withColumn("exists", F.lit(True))
    known = firsts.join(taken.hint("merge"), "name", "full").select("name", "first", F.coalesce("exists", F.lit(False)).alias("exists"), base.alias("origin"), number.alias("number"))
    known = known.join(firsts.select(F.col("name").alias("origin"), F.lit(True).alias("wanted")).hint("merge"), "origin", "left")
    deep = F.when(F.col("wanted"), F.size(F.regexp_extract_all("name", F.lit(r"\([1-9][0-9]*\)"), F.lit(0)))).otherwise(0)
    known = written(known.select("name", "first", "exists", *[F.when(F.col("wanted"), F.col(c)).alias(c) for c in ("origin", "number")], deep.alias("depth")), f"{path}/known")
    depths = [r[0] for r in known.where("first IS NOT NULL").select("depth").distinct().orderBy("depth").collect()]  # no more than a name has brackets
    out, lost = [], known.where("exists").select("name")  # names that exist, or went to their origin before they were asked for
    for turn, depth in enumerate(depths):
        names_ = known.where((F.col("depth") == depth) & F.col("first").isNotNull()).select("name")
        mine = asked.join(names_.hint("merge"), "name", "left_semi")
        gone = names_.join(lost.hint("merge"), "name", "left_semi").select("name", F.lit(0).cast("long").alias("i"))
        forms = known.where("origin IS NOT NULL").join(names_.select(F.col("name").alias("origin")).hint("merge"), "origin", "left_semi")
        gone = gone.unionByName(forms.where("exists").select(F.col("origin").alias("name"), F.col("number").alias("i")))
        rivals = forms.where("NOT exists").select(F.col("origin").alias("name"), F.col("number").alias("i"), F.col("name").alias("form"), F.col("first").alias("seq"))
        passed = _passed_over(mine, gone, rivals, f"{path}/{turn}")
        given = written(_given(mine, gone.unionByName(passed.select("name", "i"))), f"{path}/{turn}/given")
        out.append(given.select("seq", F.col("form").alias("out_name")))
        used = given.where("i > 0").select(F.col("form").alias("name"), F.col("seq").alias("by"))
        lost = lost.unionByName(used.join(firsts.hint("merge"), "name").where("by < first").select("name"))
    return reduce(DataFrame.unionByName, out) if out else wanted.select("seq", F.lit(None).cast("string").alias("out_name")).limit(0)


def _passed_over(asked: DataFrame, gone: DataFrame, rivals: DataFrame, path: str) -> DataFrame:
    """Of rivals (name, i, form, seq: who asks for the form by its own name first), those whose seq comes before the turn of form i.

    Requests before seq are n; free forms up to i are r, so the form's turn comes with request r - m, if m rivals before it are
    passed over: it is, if m < r - n.
    """
    events = asked.select("name", "seq", F.lit(1).alias("ask"), F.lit(None).cast("long").alias("i")).unionByName(rivals.select("name", "seq", F.lit(0).alias("ask"), "i"))
    counted = running(events, ["name"], ["seq"], {"n": F.col("ask")}).where("ask = 0").select("name", "i", "n")
    places = counted.select("name", "i", "n", F.lit(0).alias("gone")).unionByName(gone.select("name", "i", F.lit(None).cast("long").alias("n"), F.lit(1).alias("gone")))
    free = running(places, ["name"], ["i"], {"g": F.col("gone")}).where("gone = 0").select("name", "i", (F.col("i") + 1 - F.col("g") - F.col("n")).alias("d"), F.lit(False).alias("over"))
    for turn in count():
        free = written(free, f"{path}/over{turn}")
        if turn and not free.where("changed").limit(1).count():
            return free.where("over")
        before = running(free.select("name", "i", "d", "over"), ["name"], ["i"], {"m": F.col("over").cast("long")})
        now = (F.col("m") - F.col("over").cast("long")) < F.col("d")
        free = before.select("name", "i", "d", now.alias("over"), (now != F.col("over")).alias("changed"))


def _given(asked: DataFrame, gone: DataFrame) -> DataFrame:
    """The k-th request of a name takes its k-th form that isn't gone: number k - 1, and one more for each gone form before which fewer than k are free."""
    ranked = numbered(gone, "name", ["i"]).select("name", (F.col("i") - (F.col("k") - 1)).alias("at"), F.lit(0).alias("turn"), F.lit(None).cast("int").alias("k"), F.lit(None).cast(asked.schema["seq"].dataType).alias("seq"))
    turns = asked.select("name", (F.col("k") - 1).cast("long").alias("at"), F.lit(1).alias("turn"), "k", "seq")
    i = F.col("k") - 1 + F.col("g")
    stem, ending = F.regexp_extract("name", _PARTS, 1), F.regexp_extract("name", _PARTS, 2)
    stem = F.when(stem == "", F.col("name")).otherwise(stem)
    form = F.when(i == 0, F.col("name")).otherwise(F.concat(stem, F.lit("("), i.cast("string"), F.lit(")"), ending))
    return running(turns.unionByName(ranked), ["name"], ["at", "turn", "k"], {"g": 1 - F.col("turn")}).where("turn = 1").select("seq", i.cast("long").alias("i"), form.alias("form"))


def dedup_labels(paths: DataFrame) -> DataFrame:
    """label of each path by seq: its file name; if that is taken, with its folder; if that is too, with the next number from 2.

    seq is unique. First rows of a file name, and of a file name in a folder, are minima; the numbers of the rest are a running count in two levels.
    """
    base, parent = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    rows = paths.withColumns({"base": base, "parent": parent})
    first = rows.where("seq IS NOT NULL").groupBy("base").agg(F.min("seq").alias("first"))
    rows = rows.join(first.hint("merge"), "base")
    second = rows.where("seq > first").groupBy("base", "parent").agg(F.min("seq").alias("second"))
    rows = rows.join(second.hint("merge"), ["base", "parent"], "left")
    late = (F.col("seq") > F.col("first")) & (F.col("seq") > F.col("second"))
    rows = running(rows, ["base"], ["seq"], {"m": late.cast("long")})
    label = F.when(F.col("seq") == F.col("first"), F.col("base")).when(F.col("seq") == F.col("second"), F.concat("base", F.lit(" — "), "parent")).otherwise(F.concat("base", F.lit(" — "), (F.col("m") + 1).cast("string")))
    return rows.select("seq", label.alias("label"))


def first_match(candidates: DataFrame, available: DataFrame) -> DataFrame:
    """value of each key's first candidate, by priority, that is available."""
    return candidates.join(available.select("value").distinct(), "value").groupBy("key").agg(F.min_by("value", F.struct("priority", "value")).alias("value"))


def name_score(name: Column, rules: list[tuple[str, int]], other: int, good: str, penalty: int) -> Column:
    """The score of the first rule (a pattern) that the lower-case name matches, plus a penalty for endings other than `good`; `other` if none does."""
    low = F.lower(name)
    extra = F.when(low.rlike(good), 0).otherwise(penalty)
    score = None
    for pattern, value in rules:
        score = F.when(low.rlike(pattern), extra + value) if score is None else score.when(low.rlike(pattern), extra + value)
    return score.otherwise(other) if score is not None else F.lit(other)


def rank_names(names: DataFrame, score: Column) -> DataFrame:
    """The best name of each key: least score, then the name in lower case."""
    return names.groupBy("key").agg(F.min_by("name", F.struct(score, F.lower("name"), F.col("name"))).alias("name"), F.min(score).alias("score"))


def distinct_keep_first(rows: DataFrame, value: str, seq: str) -> DataFrame:
    return rows.groupBy(value).agg(F.min(seq).alias(seq))
