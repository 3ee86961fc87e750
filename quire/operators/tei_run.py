"""Work units to TEI by a model: which units are sent, with which prompt, what comes back, and the log of it.

A model is a callable from prompts to answers; a rule-based stub stands in for it where there is no network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.classify import Model, _caller, build_prompt, with_retry
from quire.operators.tei import Converter, quality_flags, strip_fence, wrap
from quire.plans.runtime import cut

#: Strategies whose units are chapters or parts of them, and the one that is never converted.
CHAPTERS = ("explicit_chapter", "implicit_chapter_stars", "implicit_chapter_jpg")
UNSPLIT = "novel_no_separator"
CHAPTER_PROMPT = "Convert the HTML of a chapter to TEI. Answer with the TEI only, without an outer div.\n\nHTML Input:\n"
OTHER_PROMPT = "Label the HTML of a front or back matter page and convert it to TEI. Answer with one div whose type is the label.\n\nHTML Input:\n"
#: The log's columns and its words for findings.
LOG = ("timestamp", "chunk_id", "status", "strategy", "wrapped_div", "uncertain_found", "unknown_type_found", "error_message")
FOUND_UNCERTAIN, FOUND_UNKNOWN, NOT_FOUND = "YES (<uncertain>)", "YES (<div type='unknown'>)", "no"
WRAPPED_HERE, WRAPPED_BY_MODEL, NOT_WRAPPED = "Script-Wrapped", "LLM-Wrapped", "None"


def select_units(units: DataFrame, chapters: bool = True, others: bool = True) -> DataFrame:
    """The units a run is to convert: chapters, others, or both. Unsplit novels never are."""
    chapter = F.col("strategy").isin(*CHAPTERS)
    wanted = (chapter & F.lit(chapters)) | (~chapter & F.lit(others))
    return units.where(wanted & (F.col("strategy") != UNSPLIT))


def prompt_of(text: Column, strategy: Column) -> Column:
    """The prompt by kind of unit."""
    return F.when(strategy.isin(*CHAPTERS), build_prompt(text, CHAPTER_PROMPT)).otherwise(build_prompt(text, OTHER_PROMPT))


def convert_stub(prompts: list[str]) -> list[str]:
    """The rule-based converter in the form of a model: a fenced answer, for other than chapters in a div of unknown type."""
    out = []
    for p in prompts:
        chapter = p.startswith(CHAPTER_PROMPT)
        tei = Converter().fragment(p[len(CHAPTER_PROMPT if chapter else OTHER_PROMPT) :])
        out.append(f"```xml\n{tei}\n```" if chapter else f'```xml\n<div type="unknown">{tei}</div>\n```')
    return out


def run(
    units: DataFrame, stamp: Column, model: Model = convert_stub, done: DataFrame | None = None, chapters: bool = True, others: bool = True, batch: int = 20, tries: int = 5, base: float = 1.0, pause: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """(id, tei) of the units converted, and the run's log with the columns of LOG, all strings.

    units has id, html and strategy. Ids in `done` are passed over without a log row, as are units the switches leave
    out; unsplit novels are logged as Skipped; a call that fails for good as Error. Answers are written once, so both
    results come from the same calls. An empty table gives two empty ones.
    """
    todo = select_units(units, chapters, others)
    if done is not None:
        todo = todo.join(done.select("id").distinct(), "id", "left_anti")
    asked = todo.select("id", prompt_of(F.col("html"), F.col("strategy")).alias("prompt"), "strategy").where("prompt IS NOT NULL")
    # the strategy travels in the id, so that the answers need no join
    joint = asked.select(F.concat_ws("\x1f", "strategy", "id").alias("id"), "prompt")
    called = joint.mapInArrow(_caller(with_retry(model, tries, base), batch, pause), "id string, answer string, status string, error_message string")
    parts = F.split("id", "\x1f", 2)
    got = cut(called.select(parts[0].alias("strategy"), parts[1].alias("id"), strip_fence(F.col("answer")).alias("answer"), "status", "error_message"), "answers")
    chapter = F.col("strategy").isin(*CHAPTERS)
    uncertain, unknown = quality_flags(F.col("answer"), F.col("strategy"))
    converted = got.where("status = 'Success'")
    tei = converted.select("id", F.when(chapter, wrap(F.col("answer"), F.col("strategy"))).otherwise(F.col("answer")).alias("tei"))
    say = lambda flag, word: F.when(F.coalesce(flag, F.lit(False)), word).otherwise(NOT_FOUND)
    stamped = stamp.cast("string")
    log = got.select(stamped, "id", "status", "strategy", F.when(F.col("status") != "Success", NOT_WRAPPED).when(chapter, WRAPPED_HERE).otherwise(WRAPPED_BY_MODEL), say(uncertain, FOUND_UNCERTAIN), say(unknown, FOUND_UNKNOWN), F.coalesce("error_message", F.lit(""))).toDF(*LOG)
    unsplit = units.where(F.col("strategy") == UNSPLIT).select(stamped, "id", F.lit("Skipped"), "strategy", F.lit(NOT_WRAPPED), F.lit(NOT_FOUND), F.lit(NOT_FOUND), F.lit("no separator found: the novel is one block and isn't converted")).toDF(*LOG)
    return tei, log.unionByName(unsplit)
