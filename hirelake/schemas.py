"""Schemas of the relational model; CSV and JSON sources are read with these, never inferred."""

COMPANIES = (
    "id long, name string, homepage_url string, recruits_url string, page_type string, post_type string, hiring boolean, recruits_url_status string, "
    "recruits_url_score int, logo_url string, industry string, address string, region string, external_job_site string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
JOB_POSTINGS = (
    "id long, company_id long, title string, post_url string, job_description string, qualifications string, preferred_qualifications string, hiring_process string, "
    "benefits string, hiring_message string, location string, employment_type string, salary string, work_hours string, posted_at date, deadline_at date, status string, "
    "crawled_at timestamp_ntz, first_seen_at timestamp_ntz, is_active boolean"
)
TRAINEES = (
    "id long, counseling_date date, student_code string, name_alias string, birth_date date, gender string, education_level string, major string, academy_rank int, "
    "career_summary string, career_months int, course_name string, counseling_summary string, counselor_name string, note string, preferred_company_size int, "
    "preferred_industry string, preferred_employment_type string, preferred_job_skill string, preferred_location string, preferred_salary string, tech_stack string, "
    "welfare_preferences string, required_conditions string"
)
STUDENT = "struct<skills:array<string>,location:string,employment:string,welfare:array<string>,salary_min:double,industry:string,etc:array<string>,required:array<string>>"
COUNSELING_REQUEST = "text string, only_fields array<string>"
