"""Answers from search results: acceptance, refusal, follow-up questions, synthesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import casefold, shown_tags
from fathom.operators.ngram import generate_from

NOTICE = "Experimental offline research tool. Verify critical decisions with trusted human expertise whenever possible."
REFUSAL = "I do not have enough confidence to answer this question from the current knowledge base."
SYNTHESIS_NOTICE = "Experimental synthesis. Generated only from the retrieved passage below; use the cited passage as the authority."
#: In this order: the words that call for a pair of questions, and the questions.
RULES = [
    ("carbon-monoxide|carbon monoxide|generator|gas|fuel", ["Do you smell gas or fuel, or does anyone feel dizzy, weak, nauseated, or confused?", "Can you move people to fresh air before doing anything else?"]),
    ("bleeding|wound|burn|injury|injured|medical|unconscious", ["Is anyone injured, bleeding heavily, unconscious, or not breathing normally?", "Do you have clean cloth, safe water, or first aid supplies nearby?"]),
    ("water|dehydration|purification|boil|drink", ["Does the water smell like fuel, chemicals, sewage, or solvents?", "Can you boil it, or do you only have filters, cloth, or disinfectant?"]),
    ("food|refrigerator|freezer|spoiled|perishable", ["How long has the refrigerator or freezer been without power?", "Does any food smell wrong, feel slimy, show mold, or have leaking packaging?"]),
    ("battery|phone|radio|communication|signal", ["Do you need to contact someone now, or can the phone stay in low-power mode?", "Have you written critical numbers or instructions on paper?"]),
    ("navigation|compass|lost|north|direction", ["Are you safer staying put than moving right now?", "Can you confirm direction with more than one clue before traveling?"]),
]
GENERAL = ["Is anyone in immediate danger right now?", "What is the next practical action you need to decide?"]


def acceptable(confidence: Column) -> Column:
    return confidence.isin("HIGH", "MEDIUM")


def first_acceptable(results: DataFrame) -> DataFrame:
    """The best-ranked acceptable row of each query."""
    columns = [c for c in results.columns if c != "qid"]
    best = F.min_by(F.struct(*columns), "rank").alias("r")
    return results.filter(acceptable(F.col("confidence"))).groupBy("qid").agg(best).select("qid", "r.*")


def result_text() -> Column:
    """What triage reads of a result."""
    return casefold(F.concat_ws(" ", "title", "path", "body", F.array_join("tags", " "), "passage", F.array_join("matched_terms", " ")))


def follow_up_questions(text: Column, most: int = 2) -> Column:
    """Questions of every rule that the text calls for, in order, until there are most; general ones where none applies."""
    quoted = lambda q: F.array(*map(F.lit, q))
    none = F.array().cast("array<string>")
    asked = F.concat(*[F.when(text.rlike(words), quoted(q)).otherwise(none) for words, q in RULES])
    return F.slice(F.array_distinct(F.when(F.size(asked) > 0, asked).otherwise(quoted(GENERAL))), 1, most)


def formatted() -> Column:
    return F.concat(F.lit("["), "confidence", F.lit(" CONFIDENCE]\n\nTitle: "), "title", F.lit("\nSource: "), "path", F.lit("\nLanguage: "), "language", F.lit("\nTags: "), shown_tags(F.col("tags")), F.lit("\n\nPassage:\n"), "passage", F.lit("\n\n" + NOTICE))


def synthesised() -> Column:
    note = generate_from(F.col("passage"), F.col("query"))
    return F.concat(
        F.lit("["), "confidence", F.lit(f" CONFIDENCE]\n\n{SYNTHESIS_NOTICE}\n\nGenerated note:\n"), F.when(note == "", F.col("passage")).otherwise(note), F.lit("\n\nCitation:\nTitle: "), "title",
        F.lit("\nSource: "), "path", F.lit("\nLanguage: "), "language", F.lit("\nTags: "), shown_tags(F.col("tags")), F.lit("\n\nRetrieved passage:\n"), "passage", F.lit("\n\n" + NOTICE),
    )


def answers(queries: DataFrame, results: DataFrame, triage: bool = True, synthesis: bool = False) -> DataFrame:
    """(qid, accepted, path, answer) of every query; the refusal where no result is acceptable."""
    best = first_acceptable(results)
    said = synthesised() if synthesis else formatted()
    if triage:
        said = F.concat(said, F.lit("\n\nFollow-up checks:\n- "), F.array_join(follow_up_questions(result_text()), "\n- "))
    found = best.select("qid", "path", said.alias("said"))
    return queries.select("qid").join(found, "qid", "left").select("qid", F.col("said").isNotNull().alias("accepted"), "path", F.coalesce("said", F.lit(f"{REFUSAL}\n\n{NOTICE}")).alias("answer"))
