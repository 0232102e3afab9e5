"""Dictionary predicates: skills, sections, verbs, phrases and soft-skill markers, on folded text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.functions.text import collapse, fold, fold_text, folded_words

# Results follow from these words.
SKILLS = {
    "Python": ("python",),
    "Java": ("java",),
    "JavaScript": ("javascript", "java script", "js"),
    "TypeScript": ("typescript", "type script"),
    "C#": ("c#", "c sharp"),
    "C++": ("c++",),
    ".NET": (".net", "dotnet"),
    "ASP.NET MVC": ("asp.net mvc", "asp net mvc"),
    "Spring Boot": ("spring boot",),
    "React": ("react", "reactjs", "react.js"),
    "Angular": ("angular",),
    "Vue.js": ("vue.js", "vuejs", "vue js"),
    "Node.js": ("node.js", "nodejs", "node js"),
    "FastAPI": ("fastapi",),
    "Flask": ("flask",),
    "Django": ("django",),
    "Laravel": ("laravel",),
    "Flutter": ("flutter",),
    "Kotlin": ("kotlin",),
    "Swift": ("swift",),
    "SQL": ("sql",),
    "MySQL": ("mysql",),
    "PostgreSQL": ("postgresql", "postgres"),
    "SQL Server": ("sql server", "mssql"),
    "MongoDB": ("mongodb", "mongo db"),
    "Redis": ("redis",),
    "REST API": ("rest api", "restful api", "restful"),
    "GraphQL": ("graphql",),
    "Docker": ("docker",),
    "Kubernetes": ("kubernetes", "k8s"),
    "Git": ("git",),
    "GitHub Actions": ("github actions",),
    "Jenkins": ("jenkins",),
    "CI/CD": ("ci/cd", "continuous integration", "continuous delivery"),
    "AWS": ("aws", "amazon web services"),
    "Azure": ("azure",),
    "Google Cloud": ("google cloud", "gcp"),
    "Machine Learning": ("machine learning",),
    "Deep Learning": ("deep learning",),
    "Computer Vision": ("computer vision",),
    "NLP": ("natural language processing", "nlp"),
    "PyTorch": ("pytorch",),
    "TensorFlow": ("tensorflow",),
    "Scikit-learn": ("scikit-learn", "sklearn"),
    "Pandas": ("pandas",),
    "NumPy": ("numpy",),
    "OpenCV": ("opencv",),
    "Power BI": ("power bi",),
    "Tableau": ("tableau",),
    "UML": ("uml",),
    "Agile": ("agile",),
    "Scrum": ("scrum",),
    "Jira": ("jira",),
    "Unit Testing": ("unit testing", "unit test", "junit", "pytest", "xunit"),
    "Figma": ("figma",),
    "HTML": ("html",),
    "CSS": ("css",),
}
ACTION_VERBS = (
    "achieved", "analyzed", "architected", "automated", "built", "created", "designed", "developed", "deployed", "engineered",
    "implemented", "improved", "integrated", "led", "managed", "optimized", "refactored", "reduced", "streamlined",
    "tăng", "giảm", "xây dựng", "phát triển", "thiết kế", "triển khai", "tối ưu", "phân tích", "quản lý", "dẫn dắt",
)
PASSIVE_PHRASES = ("responsible for", "participated in", "helped with", "assisted with", "worked on", "chịu trách nhiệm", "tham gia vào", "hỗ trợ việc")
SECTIONS = {
    "summary": ("summary", "profile", "objective", "about me", "mục tiêu", "giới thiệu"),
    "skills": ("skills", "technical skills", "kỹ năng"),
    "experience": ("experience", "work experience", "employment", "kinh nghiệm"),
    "projects": ("projects", "project", "dự án"),
    "education": ("education", "academic", "học vấn", "giáo dục"),
}
SOFT_MARKERS = (
    "active listening", "adaptability", "attention to detail", "collaboration", "communication", "critical thinking", "interpersonal",
    "leadership", "listening", "presentation", "problem solving", "problem-solving", "responsibility", "team work", "teamwork",
    "time management", "willingness to learn", "chu dong", "giai quyet van de", "giao tiep", "hoc hoi", "hop tac",
    "kha nang lam viec nhom", "ky nang lam viec nhom", "lam viec nhom", "lang nghe", "lanh dao", "quan ly thoi gian", "thich nghi",
    "thuyet trinh", "trach nhiem", "tu duy phan bien",
)
#: All three forms begin with a digit, so other places are set aside by one test.
QUANTIFIED = r"(?U)(?=\d)(?:\d+[.,]?\d*\s*%|\b\d{2,}[+]?\b|\b\d+[xX]\b)"


def any_of(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_word(folded: str) -> bool:
    """Whether an alias counts as a word, or words: ASCII letters, digits and blanks alone. Others count anywhere."""
    return bool(re.fullmatch("[a-z0-9 ]+", folded))


def skills_in(folded: Column) -> Column:
    """Skills that a folded text names, in dictionary order.

    One pass cuts the text into words and keeps those of the dictionary, whatever its size; an alias of one word is looked
    up among them, and the text is searched again only for aliases of which all words are there. Aliases with other
    characters, of which there are few, are searched for as they stand."""
    names = {name: [fold_text(a) for a in aliases] for name, aliases in SKILLS.items()}
    vocabulary = dict.fromkeys(w for aliases in names.values() for a in aliases if is_word(a) for w in a.split(" "))
    words = F.array_intersect(F.split(folded, "[^a-z0-9]+"), F.array(*[F.lit(w) for w in vocabulary]))

    def named(have: Column, alias: str) -> Column:
        if not is_word(alias):
            return folded.contains(alias)
        parts = alias.split(" ")
        all_there = F.array_contains(have, parts[0])
        for w in parts[1:]:
            all_there = all_there & F.array_contains(have, w)
        return all_there if len(parts) == 1 else all_there & folded.rlike(f"(?<![a-z0-9]){alias}(?![a-z0-9])")

    found = lambda have: F.array_compact(F.array(*[F.when(any_of(named(have, a) for a in aliases), F.lit(n)) for n, aliases in names.items()]))
    return F.transform(F.array(words), found)[0]  # a lambda's variable is evaluated once


def dictionary(spark: SparkSession) -> DataFrame:
    """The skill dictionary as rows (ord, canonical, alias); about a hundred."""
    rows = [(i, name, a) for i, (name, aliases) in enumerate(SKILLS.items()) for a in aliases]
    return spark.createDataFrame(rows, "ord int, canonical string, alias string")


def grams(folded: Column, most: int) -> Column:
    """Runs of one to `most` words of a folded text that a single blank parts and nothing else."""
    # other characters and longer blanks are words of their own, which no alias holds
    words = F.regexp_extract_all(folded, F.lit("[a-z0-9]+|[^a-z0-9 ]+| {2,}"), F.lit(0))

    def cut(all_: Column) -> Column:
        out, runs = [all_], all_
        for n in range(2, most + 1):
            # the last n - 1 runs have no such word, so they become null
            runs = F.zip_with(runs, F.slice(all_, F.lit(n), F.size(all_)), lambda x, y: F.concat(x, F.lit(" "), y))
            out.append(runs)
        return F.concat(*out)

    return F.transform(F.array(words), cut)[0]


#: Aliases up to which a dictionary is broadcast, and those with other characters that it may hold at most.
BROADCAST_ALIASES, MOST_ODD = 200_000, 1000
#: Aliases of several words that one word may stand for; those of a more crowded word are met by their runs of words.
ANCHORED = 20


def skills_by_join(texts: DataFrame, key: str, folded: str, aliases: DataFrame | None = None) -> DataFrame:
    """skills_in for a dictionary of any size, given as rows (ord, canonical, alias): (key, skills) of texts that name any.

    A text's distinct words meet the aliases by hash, an alias of several words by its longest one, and is then searched for;
    where a word stands for many aliases, these meet the text's runs of words instead. The dictionary is counted and broadcast
    while it is small. Aliases with characters beside a-z, 0-9 and blanks are searched for in each text; a dictionary of over
    MOST_ODD of them is refused. White space inside an alias is one blank. A null text, a null or empty alias name nothing;
    rows of equal keys are one text; texts and dictionary may have other columns."""
    aliases = dictionary(texts.sparkSession) if aliases is None else aliases
    skill = F.struct(F.col("ord"), F.col("canonical")).alias("skill")
    rows = aliases.select(skill, collapse(fold(F.col("alias"))).alias("alias")).where("alias != ''").withColumn("word", F.col("alias").rlike("^[a-z0-9 ]+$"))
    parts = F.split("alias", " ")
    longest = F.array_max(F.transform(parts, lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    rows = rows.withColumn("parts", F.when(F.col("word"), F.size(parts)).otherwise(1)).withColumn("anchor", F.when(F.col("word"), longest).otherwise(F.col("alias")))
    n, odd = _counted(rows)
    small = n <= BROADCAST_ALIASES
    # a dictionary that is shuffled meets all aliases of several words by runs, so that no text travels with its words
    crowded = rows.where("parts > 1").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (ANCHORED if small else 0)).select("anchor")
    by_run = rows.where("parts > 1").join(crowded, "anchor", "left_semi").select("alias", "skill", "parts")
    anchored = rows.where("parts > 1").join(crowded, "anchor", "left_anti").select(*rows.columns) if small else rows.limit(0)
    by_word = rows.where("parts = 1").union(anchored)
    runs_n, most = by_run.agg(F.count(F.lit(1)), F.max("parts")).first()

    doc = texts.select(F.col(key).alias("key"), F.col(folded).alias("folded"))
    words = F.array_distinct(F.split("folded", "[^a-z0-9]+"))
    met = F.concat(words, F.array_compact(F.array(*[F.when(F.col("folded").contains(x), F.lit(x)) for x in odd]))) if odd else words
    if small:
        there = (F.col("parts") == 1) | (F.col("folded").contains(F.col("alias")) & F.expr("folded rlike concat('(?<![a-z0-9])', alias, '(?![a-z0-9])')"))
        hits = doc.select("key", "folded", F.explode(met).alias("anchor")).join(F.broadcast(by_word), "anchor").where(there).select("key", "skill")
    else:
        hits = doc.select("key", F.explode(met).alias("anchor")).join(by_word, "anchor").select("key", "skill")
    if runs_n:
        runs = doc.select("key", F.explode(grams(F.col("folded"), most)).alias("alias"))
        hits = hits.union(runs.join(F.broadcast(by_run) if small else by_run, "alias").select("key", "skill"))
    by_text = hits.groupBy("key").agg(F.array_sort(F.collect_set("skill")).alias("s"))
    return by_text.select(F.col("key").alias(key), F.col("s.canonical").alias("skills"))


def _counted(rows: DataFrame) -> tuple[int, list[str]]:
    """How many aliases there are, and those of other characters."""
    odd = [r["alias"] for r in rows.where("not word").select("alias").limit(MOST_ODD + 1).collect()]
    if len(odd) > MOST_ODD:
        raise ValueError(f"over {MOST_ODD} aliases have characters beside a-z, 0-9 and blanks")
    return rows.where("word").count(), list(dict.fromkeys(odd))


def sections_in(folded: Column) -> dict[str, Column]:
    """Which sections a folded text has, by any of their names."""
    return {name: any_of(folded.contains(fold_text(a)) for a in aliases) for name, aliases in SECTIONS.items()}


def phrases_in(folded: Column, phrases) -> Column:
    """Phrases whose folded form occurs anywhere, in code point order and original spelling."""
    return F.array_compact(F.array(*[F.when(folded.contains(fold_text(p)), F.lit(p)) for p in sorted(phrases)]))


def is_quantified(line: Column) -> Column:
    return line.rlike(QUANTIFIED)


def looks_soft(skill: Column) -> Column:
    """Whether a skill holds the marker of a soft skill."""
    return F.exists(F.array(*[F.lit(m) for m in SOFT_MARKERS]), lambda m: folded_words(skill).contains(m))
