"""Record types: the nested CV record, the pointer record, issues, decisions, profiles and stores, as Spark DDL."""

PERSONAL = "struct<name:string,email:string,phone:string,github_url:string>"
SKILLS = "struct<hard_skills:array<string>,soft_skills:array<string>>"
EDUCATION = "array<struct<degree:string,university:string,gpa:double,year_graduated:int>>"
SPAN = "array<int>"

CV = (
    f"struct<personal_info:{PERSONAL},summary:string,skills:{SKILLS},"
    "experience:array<struct<company:string,job_title:string,duration:string,description:string>>,"
    "projects:array<struct<name:string,role:string,technologies:array<string>,details:string>>,"
    f"education:{EDUCATION},certifications:array<string>,activities:array<string>,awards:array<string>>"
)
POINTER = (
    f"struct<personal_info:{PERSONAL},summary_span:{SPAN},skills:{SKILLS},"
    f"experience:array<struct<company:string,job_title:string,duration:string,description_span:{SPAN}>>,"
    f"projects:array<struct<name:string,role:string,technologies:array<string>,details_span:{SPAN}>>,"
    f"education:{EDUCATION},certifications:array<string>,activities:array<string>,awards:array<string>>"
)
EVIDENCE = f"map<string,struct<span:{SPAN},text:string>>"
ISSUE = "struct<code:string,field:string,message:string,category:string,retryable:boolean>"
ISSUES = f"array<{ISSUE}>"
DECISION = "struct<accepted:boolean,mode:string,policy_version:string,warnings:array<string>,rejection_reason:string,normalizations:array<string>>"

#: One row per PDF page of a document, as a PDF reader would give it: the engine starts from these columns.
PAGES = "doc_id string, page_no int, native_text string, ocr_text string, width double, dark_ratio double, blocks array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"
#: What is known of a document's layout; scores read it.
PROFILE = "struct<page_count:int,native_text_pages:int,character_count:int,block_count:int,likely_multi_column:boolean,needs_ocr:boolean>"

GENERATION = "sample_id string, eval_id string, split string, raw_output string, input_tokens int, generated_tokens int, runtime_seconds double, ended_with_eos boolean, hit_max_new_tokens boolean"
GOLD = f"sample_id string, source_text string, target_pointer {POINTER}, target_cvschema {CV}"

SUBMISSIONS = (
    "submission_id string, created_at timestamp, source_sha256 string, language string, participant_code string, "
    "consent_policy_version string, withdrawal_hash string, directory_name string, page_count int, total_score double"
)
JOBS = "token string, created_at timestamp, updated_at timestamp, status string, remote_job_id string, language string, participant_code string, research_consent boolean, error string"
REQUESTS = "identifier_hash string, created_epoch bigint"
MESSAGES = "array<struct<role:string,content:string>>"
MATCH_OUTPUT = (
    "impact_score double, impact_notes string, semantic_score double, semantic_notes string, tone_score double, tone_notes string, "
    "must_have_coverage double, matched_skills array<string>, missing_skills array<string>, unverified_skills array<string>, "
    "action_verbs_found array<string>, passive_phrases_found array<string>, quantified_lines int, strengths array<string>, improvements array<string>"
)
