"""Texts made of rows: the retrieval query of an event, the title of a ticket, and which document they are read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what stands between a cause's name and its condition's title.
SEPARATOR = " — "


def strip_digits(text: Column) -> Column:
    """Without digits and the brackets they leave empty, white space made single."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[0-9]+", ""), r"\(\s*\)", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def joined(*parts: Column) -> Column:
    """Arrays of texts as one text: blank and null ones go, the others are joined by a space, without digits."""
    every = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))
    return strip_digits(F.array_join(F.filter(every, lambda p: F.trim(p) != ""), " "))


def query_texts(events: DataFrame, conditions: DataFrame, alarms: DataFrame) -> DataFrame:
    """(event_id, text) of each event, which is given once.

    ``events`` has event_id, symptom_key and the arrays details, labels and alarm_codes; ``conditions`` symptom_key, title and the array
    symptoms; ``alarms`` code and title. A symptom without condition stands by its key's words; a code without title is left out.
    """
    code = events.select("event_id", F.posexplode("alarm_codes").alias("_at", "code")).join(alarms, "code")
    titles = code.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "title"))), lambda x: x["title"]).alias("_alarms"))
    every = events.join(conditions.withColumn("_known", F.lit(True)), "symptom_key", "left").join(titles, "event_id", "left")
    head = F.array(F.when(F.col("_known"), F.col("title")).otherwise(F.replace("symptom_key", F.lit("_"), F.lit(" "))))
    return every.select("event_id", joined(head, F.col("symptoms"), F.col("details"), F.col("labels"), F.col("_alarms")).alias("text"))


def ticket_titles(decisions: DataFrame, entries: DataFrame) -> DataFrame:
    """``decisions`` with condition_id and title, by their fault's entry; a decision of no entry is left out.

    ``decisions`` has fault_id, ticket_symptom and event_symptom; ``entries`` fault_id, name and conditions, an array of (condition_id, title). The
    condition is the one listed under the ticket's symptom, else under the event's, else the first.
    """
    listed = lambda key: F.get(F.filter("conditions", lambda c: c["condition_id"] == F.col(key)), F.lit(0))
    chosen = F.coalesce(listed("ticket_symptom"), listed("event_symptom"), F.get("conditions", F.lit(0)))
    held = decisions.join(entries, "fault_id").withColumn("_c", chosen)
    return held.withColumns({"condition_id": F.col("_c.condition_id"), "title": F.concat("name", F.lit(SEPARATOR), "_c.title")}).drop("_c", "name", "conditions")


def active_documents(runs: DataFrame, by: str) -> DataFrame:
    """(by, document_id) of the newest run that succeeded, by its end or, while it is open, its start; ties to the greater run_id."""
    newest = F.max_by("document_id", F.struct(F.coalesce("finished", "started"), "run_id"))
    return runs.where("status = 'succeeded'").groupBy(by).agg(newest.alias("document_id"))
