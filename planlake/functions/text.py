"""Text features: keyword families, pedagogy patterns, personalization signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planlake.functions.literals import matches_where_possible
from planlake.functions.nested import contains_any, count_of, first_match, let, ratio

# Families of roles, by keywords.
ROLE_FAMILIES = (
    ("tutor", ("tutor", "instructor", "teacher", "coach", "explainer", "mentor", "guide", "facilitator")),
    ("retriever", ("retriever", "docs", "documentation", "searcher", "finder", "lookup", "fetcher")),
    ("validator", ("validator", "checker", "tester", "verifier", "executor", "runner", "evaluator", "assessor")),
    ("debugger", ("debugger", "diagnostician", "analyzer", "diagnoser", "inspector", "troubleshooter")),
    ("planner", ("planner", "designer", "architect", "strategist", "coordinator", "orchestrator")),
    ("reviewer", ("reviewer", "critic", "auditor", "qa", "quality")),
    ("generator", ("generator", "writer", "composer", "author", "producer", "creator")),
    ("translator", ("translator", "interpreter", "converter", "transformer")),
)
# Phases of a lesson, by keywords.
PHASES = (
    ("probe", ("ask the learner", "have the learner predict", "ask them to predict", "what do you think", "your intuition", "prior knowledge", "before introducing", "before showing", "surface", "activate", "have them guess", "have them describe")),
    ("retrieve_demonstrate", ("look up", "retrieve", "documentation", "official", "demonstrate", "produce concrete", "show concrete", "execute the following", "run the following")),
    ("apply", ("ask the learner to write", "ask the learner to revise", "ask the learner to rewrite", "have the learner write", "have the learner implement", "submit", "write a", "implement")),
    ("validate", ("test case", "test cases", "validate", "verify", "compile", "check that", "set ", "expected_output", "outcome=", "implementation_correct")),
    ("feedback", ("explain what went wrong", "targeted feedback", "what to fix", "point to the specific", "tell the learner the precise", "give targeted feedback", "specific fix")),
    ("consolidate", ("summarize", "consolidate", "wrap up", "wrap-up", "decision rule", "transfer", "general rule", "in their own words", "decision framework", "one-line rule", "their own decision")),
)
# Patterns of teaching.
PEDAGOGY = (
    ("prediction_elicitation", r"\b(predict|prediction|guess|hypothesi[sz]e|what do you think|before showing|first ask)\b"),
    ("explanation_walkthrough", r"\b(explain|walk.{0,15}through|describe to|teach|step.by.step|illustrate)\b"),
    ("worked_example", r"\b(example|worked example|sample code|demonstration|show .{0,15}how)\b"),
    ("guided_practice", r"\b(apply|try|implement|practice|hands.on|exercise|write the code)\b"),
    ("scaffolding_iterative", r"\b(loop|iterate|until|retry|iteration|refine)\b"),
    ("validation_feedback", r"\b(validate|verify|check|test|confirm|assess|evaluate|compile|run)\b"),
    ("reflection_metacognition", r"\b(reflect|generaliz[ez]|extract.{0,10}rule|takeaway|summari[sz]e|articulate)\b"),
    ("retrieval_practice", r"\b(recall|retrieve|remember|look up|search|find.{0,10}document|fetch)\b"),
    ("analogy_priorknowledge", r"\b(analog[yi]|like.{0,10}(php|html|javascript|python|c#|c\+\+|java)|in your |from your (background|portfolio)|prior knowledge)\b"),
    ("diagnostic_assessment", r"\b(diagnos|identify.{0,10}error|misconception|gap|misunderstanding|root cause)\b"),
)
# Patterns of the three acts.
SKELETON = (
    ("activate", r"\b(activate|surface|reveal|elicit|baseline|prior knowledge|mental model|misconception|prediction|gap)\b"),
    ("apply", r"\b(apply|implement|fix|write|build|construct|debug|validate|verify|test|run|compile|loop)\b"),
    ("consolidate", r"\b(consolidate|generali[sz]e|reflect|takeaway|extract.{0,10}rule|summari[sz]e|decision rule|articulate)\b"),
)
# Words that speak to the learner.
SECOND_PERSON = r"\b(you|your|the learner)\b"
# Bridging phrases of a plan.
PLAN_ANCHORS = ("your portfolio", "your background", "your project", "as a beginner", "as a senior", "your experience", "in your", "from your", "the learner's", "given your", "you mentioned", "since you", "you already")
# Words that refer to a person.
PERSON_REFERENCE = r"\b(?:you|your|you'?re|you'?ve|yourself|the learner|learner'?s|the user)\b"
# Words that bridge within a sentence.
SENTENCE_ANCHORS = ("background", "experience", "skill", "skills", "expertise", "project", "projects", "domain", "stack", "framework", "language", "analogy", "analogous", "analogies", "bridge", "intuition", "familiar", "familiarity", "owns", "already", "compared", "unlike", "similar", "like", "draws", "drawing", "your", "the learner", "learner's", "the user", "you've")
# Stop words.
STOP_WORDS = ("the", "and", "for", "with", "from", "your", "you", "this", "that", "have", "are", "was", "were", "will", "would", "should", "could", "but", "not", "into", "what", "when", "where", "which", "why", "how", "who", "use", "using", "they", "them", "their", "all", "any", "some", "more", "most", "many", "much", "such", "than", "then", "very", "also", "just", "only", "etc")
# Forms of tokens, words and ends of sentences.
TOKEN = r"[A-Za-z][A-Za-z0-9_+#\.-]+"
DOMAIN_WORD = r"\b([A-Za-z][A-Za-z0-9+#\-]{2,})\b"
SENTENCE_END = "(?<=[.!?])\\s+(?=[A-Z\"'])"


def strip(x: Column) -> Column:
    """Without white space of any kind at either end; trim only takes blanks."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.filter(F.array_distinct(F.split(F.lower(strip(text)), r"\s+")), lambda w: w != "")


def word_jaccard(a: Column, b: Column) -> Column:
    """Word-set Jaccard; null where either side has no words."""
    from planlake.functions.nested import set_jaccard

    x, y = words(a), words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), set_jaccard(x, y))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike("(?i)" + pattern), F.lit(False))


def pedagogy_flags(text: Column, lowered: Column | None = None) -> dict[str, Column]:
    return _flags(PEDAGOGY, text, lowered)


def skeleton_flags(text: Column, lowered: Column | None = None) -> dict[str, Column]:
    return _flags(SKELETON, text, lowered)


def _flags(patterns: tuple[tuple[str, str], ...], text: Column, lowered: Column | None) -> dict[str, Column]:
    """Which patterns match; with the text in lower case at hand, each runs only where one of its literals occurs."""
    return {name: matches(text, p) if lowered is None else matches_where_possible(text, lowered, p) for name, p in patterns}


def role_family(role: Column) -> Column:
    return first_match(F.lower(F.coalesce(role, F.lit(""))), ROLE_FAMILIES, F.lit("other"))


def phase(text: Column) -> Column:
    return phase_lower(F.lower(text))


def phase_lower(lowered: Column) -> Column:
    """phase of a text that is in lower case."""
    return first_match(lowered, PHASES)


def anchor_count(text: Column, anchors: tuple[str, ...] = PLAN_ANCHORS) -> Column:
    return anchor_count_lower(F.lower(text), anchors)


def anchor_count_lower(lowered: Column, anchors: tuple[str, ...] = PLAN_ANCHORS) -> Column:
    """anchor_count of a text that is in lower case; a text is only searched for repeats of an anchor that it contains."""
    counts = [F.when(F.contains(lowered, F.lit(a)), count_of(lowered, a)).otherwise(0) for a in anchors]
    return sum(counts[1:], counts[0])


def hit_ratio(terms: Column, text: Column) -> Column:
    """The share of terms that text contains, whatever their case; null without terms."""
    return hit_ratio_lower(terms, F.lower(text))


def hit_ratio_lower(terms: Column, lowered: Column) -> Column:
    """hit_ratio of a text that is in lower case."""
    hits = let(lowered, lambda x: F.size(F.filter(terms, lambda t: F.contains(x, F.lower(t)))))
    return F.when(F.size(terms) > 0, ratio(hits, F.size(terms)))


def profile_signals(description: Column, skills: Column) -> Column:
    """Lower-case skills, and the description's words of four letters and more that are no stop words or skills."""
    own = F.filter(F.transform(F.coalesce(skills, F.array().cast("array<string>")), lambda s: F.lower(strip(s))), lambda s: s != "")
    domain = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(DOMAIN_WORD), F.lit(1)), F.lower))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    kept = F.filter(domain, lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w))
    return F.array_union(own, kept)


def personal_sentence(sentence: Column, signals: Column) -> Column:
    lowered = F.lower(sentence)
    return matches(sentence, PERSON_REFERENCE) & (F.exists(signals, lambda s: F.contains(lowered, s)) | contains_any(lowered, SENTENCE_ANCHORS))


def phase_checks(phases: Column) -> Column:
    """Mean of five checks over the phases of steps in order: an early probe, a validation, feedback, a late consolidation, and phases that first occur in canonical order."""

    def checks(ps: Column) -> Column:
        n = F.size(ps)
        at = {name: F.array_position(ps, name) - 1 for name, _ in PHASES}
        firsts = F.filter(F.array(*at.values()), lambda p: p >= 0)
        flags = [
            (at["probe"] >= 0) & (at["probe"] < F.greatest((n.cast("double") * 0.5).cast("int"), F.lit(1))),
            at["validate"] >= 0,
            at["feedback"] >= 0,
            (at["consolidate"] >= 0) & (at["consolidate"] >= (n.cast("double") * 0.6).cast("int")),
            (F.size(firsts) >= 2) & (firsts == F.array_sort(firsts)),
        ]
        total = sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))
        return F.when(n > 0, total / F.lit(5.0)).otherwise(0.0)

    return let(F.transform(phases, lambda p: F.coalesce(p, F.lit(""))), checks)


def ability_level(tags: Column, about: Column, intermediate: list[str], advanced: list[str], senior: list[str], novice: list[str]) -> Column:
    """1 to 4 for one ability: from tags (2, 3) and from phrases about oneself (4); at least 2 unless a novice by one's own words."""
    lowered = F.lower(F.coalesce(about, F.lit("")))
    has = lambda names: F.coalesce(F.arrays_overlap(F.transform(tags, F.lower), F.array(*[F.lit(x) for x in names])), F.lit(False))
    level = F.greatest(F.lit(1), F.when(has(intermediate), 2), F.when(has(advanced), 3), F.when(contains_any(lowered, senior), 4))
    return F.when(contains_any(lowered, novice), level).otherwise(F.greatest(F.lit(2), level))


def ability_levels(tags: Column, about: Column, abilities: list[dict], novice: list[str]) -> Column:
    """array<int>: a level from 1 to 4 for each of abilities, in order; see ability_level.

    abilities: objects with name, intermediate and advanced (tags) and senior (phrases about oneself), a parameter read from a file of the caller's.
    """
    return F.array(*[ability_level(tags, about, a["intermediate"], a["advanced"], a["senior"], novice) for a in abilities])


def ability_profile(levels: Column, descriptions: list[tuple[str, list[str]]]) -> Column:
    """Text with a line for each ability (name, its levels' descriptions from 1 on) of the learner's levels, each held within what is described."""
    lines = []
    for i, (name, told) in enumerate(descriptions):
        level = F.greatest(F.lit(1), F.least(F.lit(len(told)), F.element_at(levels, i + 1)))
        lines.append(F.concat(F.lit(f"- {name} (level "), level.cast("string"), F.lit(f"/{len(told)}): "), F.element_at(F.array(*[F.lit(t) for t in told]), level)))
    return F.concat(F.lit("Student ability profile:\n"), F.concat_ws("\n", *lines))


def describe_learner(fields: dict[str, Column]) -> Column:
    """Lines "name: value" of the fields that have one."""
    return F.concat_ws("\n", *[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items()])


def without_fences(text: Column) -> Column:
    """Text without think blocks and the marks of a code fence around it."""
    plain = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(plain, r"(?m)^\s*```[A-Za-z]*\s*$", ""))
