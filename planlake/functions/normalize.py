"""Projections that bring records of several layouts into one shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planlake.functions.nested import arrayed
from planlake.functions.text import strip


def filled(*choices: Column) -> Column:
    """The first text that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(""))


def filled_list(*choices: Column) -> Column:
    """The first list with elements, else an empty one."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in choices], F.array().cast("array<string>"))


def question_text(title: Column, body: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")))


def profile_of(author: Column) -> Column:
    tags = F.transform(F.filter(arrayed(author["top_tags"]), lambda t: t["tag_name"].isNotNull()), lambda t: t["tag_name"])
    return F.struct(F.coalesce(author["about_me"], F.lit("")).alias("self_description"), tags.alias("skills"))


def accepted_body(answer: Column) -> Column:
    return F.when(answer["answer"]["is_accepted"], F.coalesce(answer["answer"]["body"], F.lit("")))


def first_accepted(answers: Column) -> Column:
    hit = F.try_element_at(F.filter(arrayed(answers), lambda a: a["answer"]["is_accepted"]), F.lit(1))
    return F.when(hit.isNotNull(), F.coalesce(hit["answer"]["body"], F.lit("")))


def learner(value: Column, own_words_first: bool = True, about_only: bool = False) -> Column:
    """struct<description, skills> of a learner in either layout; own_words_first says which of two descriptions wins, about_only reads the about_me layout alone."""
    texts = [value["self_description"], value["about_me"]]
    lists = [value["skills"], value["top_tags"]]
    if about_only:
        texts, lists = texts[1:], lists[1:]
    elif not own_words_first:
        texts, lists = texts[::-1], lists[::-1]
    return F.struct(strip(filled(*texts)).alias("description"), filled_list(*lists).alias("skills"))


def slim(value: Column, *keys: str) -> Column:
    """A struct of some of a struct's fields."""
    return F.struct(*[value[k].alias(k) for k in keys])


def agent(a: Column) -> Column:
    return F.struct(a["agent_role"].alias("agent_role"), a["goal"].alias("goal"), filled(a["backstory"], a["description"]).alias("backstory"), arrayed(a["tools"]).alias("tools"))


def outline(output: Column) -> Column:
    """Agents and subtasks without their steps."""
    return F.struct(
        F.transform(arrayed(output["agents"]), agent).alias("agents"),
        F.transform(arrayed(output["subtasks"]), lambda s: F.struct(s["id"].alias("id"), s["name"].alias("name"), s["subtask_objective"].alias("subtask_objective"))).alias("subtasks"),
    )


def schedule(output: Column) -> Column:
    """Subtasks' steps and the order of execution."""
    return F.struct(
        F.transform(arrayed(output["subtasks"]), lambda s: F.struct(s["id"].alias("id"), arrayed(s["steps"]).alias("steps"))).alias("subtasks"),
        output["execution_order"].alias("execution_order"),
    )


def with_input(plan: Column, query: Column, who: Column, keep: bool = False) -> Column:
    """plan whose input is query and who; with keep, only where it has none of its own."""
    q, w = (F.coalesce(plan["input"]["query"], query), F.coalesce(plan["input"]["learner"], who)) if keep else (query, who)
    return plan.withField("input", F.struct(q.alias("query"), w.alias("learner")))


def profile_key(profile: Column, stripped: bool = True) -> Column:
    """struct<description, skills> that is equal for equal profiles, whatever the order of skills."""
    text, skills = F.coalesce(profile["self_description"], F.lit("")), arrayed(profile["skills"])
    if stripped:
        text, skills = strip(text), F.transform(skills, strip)
    return F.struct(text.alias("description"), F.array_sort(skills).alias("skills"))


def first_label(labels: Column) -> Column:
    """The first label of a list that is kept in alphabetical order."""
    return F.coalesce(F.array_min(labels), F.lit("UNKNOWN"))


def cut_text(text: Column, limit: int, mark: str = "") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)
