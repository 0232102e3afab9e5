"""The reproducible rubric: layout, impact, semantic match and tone of a CV against a job description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.functions.skills import ACTION_VERBS, PASSIVE_PHRASES, is_quantified, phrases_in, sections_in, skills_in
from talentlake.functions.text import clamp, display_lines, fold, has_words, overlap_tokens, round1, strip

METHOD_TEXT, METHOD_RECORD = "Deterministic web baseline v1", "Qwen Pointer P0 + deterministic matching baseline v1"
# Fixed values of reports.
VERDICTS = ((85, "Rất phù hợp"), (70, "Phù hợp"), (50, "Cần bổ sung"), (None, "Cần cải thiện nhiều"))
ATS_REASONS = ("lớp văn bản thưa, cần OCR", "nội dung trích xuất quá ngắn", "bố cục có dấu hiệu nhiều cột", "CV dài hơn 3 trang", "thiếu tiêu đề phần quan trọng")
ATS_FINE = "Cấu trúc PDF và các phần chính được nhận diện tốt."
STRONG = (
    ("Khớp %d kỹ năng với JD: %s.", "Có %d dòng chứa kết quả hoặc quy mô định lượng.", "Có động từ hành động rõ: %s."),
    "PDF có cấu trúc và lớp văn bản tương đối thuận lợi cho hệ thống tuyển dụng.",
    "CV đã cung cấp đủ dữ liệu cơ bản để hệ thống đưa ra đánh giá ban đầu.",
)
IMPROVE = (
    "JD còn các kỹ năng chưa tìm thấy: %s. Chỉ bổ sung vào CV khi bạn thực sự có kinh nghiệm và kèm minh chứng.",
    "Bổ sung số liệu thật cho thành tích, ví dụ thời gian giảm, số người dùng hoặc độ chính xác; không tự tạo số liệu.",
    "Bắt đầu mô tả kinh nghiệm bằng động từ hành động cụ thể như Developed, Implemented, Designed hoặc Tối ưu.",
    "Thay cụm bị động như %s bằng hành động và kết quả trực tiếp.",
    "Thêm phần tóm tắt nghề nghiệp ngắn, nêu vị trí mục tiêu, năng lực chính và giá trị có thể đóng góp.",
    "PDF có lớp chữ không đầy đủ. Xuất lại CV thành PDF có thể chọn văn bản để tăng độ chính xác OCR và ATS.",
    "Rà soát lại mỗi kỹ năng với một minh chứng cụ thể trong kinh nghiệm hoặc dự án.",
)
NOTE_SKILLS, NOTE_WORDS = "Đối chiếu %d/%d kỹ năng nhận diện được trong JD.", "JD không chứa kỹ năng trong từ điển v1; dùng độ phủ từ khóa nội dung."


def structured_text(cv: Column) -> Column:
    """A record's texts in the order of its fields, one a line, blank ones left out."""
    one = lambda c: F.array(c)
    rows = lambda items, *names: F.flatten(F.transform(items, lambda x: F.array(*[x[n] for n in names])))
    parts = F.concat(
        one(cv["summary"]), cv["skills"]["hard_skills"], cv["skills"]["soft_skills"], rows(cv["experience"], "company", "job_title", "duration", "description"),
        F.flatten(F.transform(cv["projects"], lambda p: F.concat(F.array(p["name"], p["role"], p["details"]), p["technologies"]))),
        rows(cv["education"], "degree", "university"), cv["certifications"], cv["activities"], cv["awards"],
    )
    return F.array_join(F.filter(parts, lambda x: strip(x) != ""), "\n")


def ats_score(profile: Column, has_skills: Column, has_education: Column, has_work: Column) -> Column:
    """Layout score, 0 to 20."""
    off = lambda test, points: F.when(test, F.lit(float(points))).otherwise(0.0)
    pages = F.least(F.lit(2.0), F.greatest(F.lit(0.0), profile["page_count"].cast("double") - 3))
    absent = F.lit(3) - has_skills.cast("int") - has_education.cast("int") - has_work.cast("int")
    lost = off(profile["needs_ocr"], 6) + off(profile["character_count"] < 500, 3) + off(profile["likely_multi_column"], 2) + pages + absent * 1.5
    return round1(clamp(20.0 - lost, 0, 20))


def ratio(n: Column, bullets: Column, share: float) -> Column:
    """A count against a share of bullet lines, three at least; 1 at most."""
    return F.least(F.lit(1.0), n / F.greatest(F.lit(3.0), bullets * share))


def impact_score(quantified: Column, actions: Column, bullets: Column) -> Column:
    return round1(clamp(5 + 17 * ratio(quantified, bullets, 0.2) + 8 * ratio(actions, bullets, 0.15), 0, 30))


def tone_score(actions: Column, passives: Column, bullets: Column) -> Column:
    return round1(clamp(5 + 10 * ratio(actions, bullets, 0.15) - 1.5 * passives, 0, 15))


def lexical_overlap(cv_tokens: Column, jd_tokens: Column) -> Column:
    """Shared tokens against 55 % of the description's, eight at least; 1 at most, 0 without tokens."""
    n = F.size(jd_tokens)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(cv_tokens, jd_tokens)) / F.greatest(F.lit(8.0), n * 0.55)))


def coverage(matched: Column, jd_skills: Column, overlap: Column) -> Column:
    """Share of the description's skills that match; without any, the lexical overlap."""
    return F.when(F.size(jd_skills) > 0, F.size(matched) / F.greatest(F.size(jd_skills), F.lit(1))).otherwise(overlap)


def verdict(total: Column) -> Column:
    out = F.lit(VERDICTS[-1][1])
    for least, name in reversed(VERDICTS[:-1]):
        out = F.when(total >= least, F.lit(name)).otherwise(out)
    return out


def text_features(rows: DataFrame, text: str) -> DataFrame:
    """rows with what scores read of a text: folded, quantified, bullets, actions, passives and found_skills. The folded
    text is a column of its own, so that it is made once."""
    lines = rows.withColumn("folded", fold(F.col(text))).withColumn("lines", display_lines(F.col(text)))
    return (
        lines.withColumn("quantified", F.size(F.filter("lines", is_quantified)))
        .withColumn("bullets", F.size(F.filter("lines", lambda x: has_words(x, 4))))
        .withColumn("actions", phrases_in(F.col("folded"), ACTION_VERBS))
        .withColumn("passives", phrases_in(F.col("folded"), PASSIVE_PHRASES))
        .withColumn("found_skills", skills_in(F.col("folded")))
        .drop("lines")
    )


def description_skills(items: DataFrame, jd: str = "jd_text", out: str = "jd_skills") -> DataFrame:
    """items with the skills that their descriptions name, made once an item, for evaluate."""
    packed = items.select(F.struct(*[F.col(c) for c in items.columns if c.lower() != out.lower()]).alias("pair"), fold(F.col(jd)).alias("folded"))
    return packed.select("pair.*", skills_in(F.col("folded")).alias(out))


def evaluate(
    pairs: DataFrame, text: str = "cv_text", jd: str = "jd_text", profile: str = "profile", cv: str | None = None, jd_skills: str | None = None
) -> DataFrame:
    """pairs with column result, one of that name being replaced: the whole evaluation of each CV against its description.

    With cv, a typed record, its structured text is read instead of `text`, its declared skills come before those found,
    and sections are those that the record fills. jd_skills names a column from description_skills, which spares reading a
    description for each of its pairs."""
    kept = [c for c in pairs.columns if c.lower() != "result"]
    read = {"read_text": structured_text(F.col(cv)) if cv else F.col(text), "read_jd": F.col(jd), "read_profile": F.col(profile)}
    if cv:
        read["read_cv"] = F.col(cv)
    wanted = F.col(jd_skills) if jd_skills else None
    if wanted is None:
        read["jd_folded"] = fold(F.col(jd))
    else:
        read["jd_skills"] = wanted
    # the caller's columns travel in a struct, so that none meets a name used below
    rows = pairs.select(F.struct(*[F.col(c) for c in kept]).alias("pair"), *[c.alias(k) for k, c in read.items()])
    if wanted is None:
        rows = rows.withColumn("jd_skills", skills_in(F.col("jd_folded"))).drop("jd_folded")
    rows = text_features(rows, "read_text")
    jd, profile = "read_jd", "read_profile"
    if cv:
        c = F.col("read_cv")
        declared = F.filter(F.transform(F.concat(c["skills"]["hard_skills"], c["skills"]["soft_skills"]), strip), lambda s: s != "")
        rows = rows.withColumn("cv_skills", F.array_distinct(F.concat(declared, "found_skills")))
        has = {"summary": strip(c["summary"]) != "", "skills": F.size(declared) > 0, **{k: F.size(c[k]) > 0 for k in ("experience", "projects", "education")}}
    else:
        rows = rows.withColumn("cv_skills", F.col("found_skills"))
        has = sections_in(F.col("folded"))
    rows = rows.withColumn("has", F.struct(*[v.alias(k) for k, v in has.items()]))
    rows = rows.withColumn("matched", F.array_sort(F.array_intersect("cv_skills", "jd_skills"))).withColumn("missing", F.array_sort(F.array_except("jd_skills", "cv_skills")))
    overlap = F.when(F.size("jd_skills") == 0, lexical_overlap(overlap_tokens(F.col("read_text")), overlap_tokens(F.col(jd)))).otherwise(0.0)
    rows = rows.withColumn("coverage", coverage(F.col("matched"), F.col("jd_skills"), overlap))
    p, h = F.col(profile), F.col("has")
    rows = rows.withColumn("n_actions", F.size("actions")).withColumn("n_passives", F.size("passives")).withColumn("scores", F.struct(
        ats_score(p, h["skills"], h["education"], h["experience"] | h["projects"]).alias("ats"),
        impact_score(F.col("quantified"), F.col("n_actions"), F.col("bullets")).alias("impact"),
        round1(35 * F.col("coverage")).alias("semantic"),
        tone_score(F.col("n_actions"), F.col("n_passives"), F.col("bullets")).alias("tone"),
    ))
    s = F.col("scores")
    rows = rows.withColumn("total", round1(s["ats"] + s["impact"] + s["semantic"] + s["tone"]))
    essential = h["skills"].cast("int") + h["education"].cast("int") + (h["experience"] | h["projects"]).cast("int")
    tests = (p["needs_ocr"], p["character_count"] < 500, p["likely_multi_column"], p["page_count"] > 3, essential < 3)
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r in zip(tests, ATS_REASONS, strict=True)]))
    some = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    matched, missing, actions, passives, quantified = (F.col(k) for k in ("matched", "missing", "actions", "passives", "quantified"))
    strong = F.array_compact(F.array(
        F.when(F.size(matched) > 0, F.format_string(STRONG[0][0], F.size(matched), some(matched, 5))),
        F.when(quantified > 0, F.format_string(STRONG[0][1], quantified)),
        F.when(F.size(actions) > 0, F.format_string(STRONG[0][2], some(actions, 5))),
        F.when(s["ats"] >= 16, F.lit(STRONG[1])),
    ))
    better = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.format_string(IMPROVE[0], some(missing, 6))),
        F.when(quantified == 0, F.lit(IMPROVE[1])),
        F.when(F.size(actions) < 2, F.lit(IMPROVE[2])),
        F.when(F.size(passives) > 0, F.format_string(IMPROVE[3], some(passives, 3))),
        F.when(~h["summary"], F.lit(IMPROVE[4])),
        F.when(p["needs_ocr"], F.lit(IMPROVE[5])),
    ))
    or_else = lambda c, text: F.when(F.size(c) > 0, c).otherwise(F.array(F.lit(text)))
    notes = F.struct(
        F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise(ATS_FINE).alias("ats"),
        F.format_string("%d dòng định lượng; %d nhóm động từ hành động.", quantified, F.size(actions)).alias("impact"),
        F.when(F.size("jd_skills") > 0, F.format_string(NOTE_SKILLS, F.size(matched), F.size("jd_skills"))).otherwise(NOTE_WORDS).alias("semantic"),
        F.format_string("%d động từ hành động; %d cụm bị động.", F.size(actions), F.size(passives)).alias("tone"),
    )
    result = F.struct(
        F.col("total").alias("total_score"), verdict(F.col("total")).alias("verdict"), s.alias("scores"), notes.alias("score_notes"), "cv_skills", "jd_skills",
        matched.alias("matched_skills"), missing.alias("missing_skills"), F.bround("coverage", 4).alias("must_have_coverage"), actions.alias("action_verbs_found"),
        passives.alias("passive_phrases_found"), quantified.alias("quantified_lines"), F.slice(or_else(strong, STRONG[2]), 1, 4).alias("strengths"),
        F.slice(or_else(better, IMPROVE[6]), 1, 5).alias("improvements"), p.alias("extraction"), F.lit(METHOD_RECORD if cv else METHOD_TEXT).alias("method"),
    )
    return rows.select("pair", result.alias("result")).select("pair.*", "result")
