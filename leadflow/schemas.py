"""Table layouts as DDL, used for explicit reads, casts and empty tables."""

EVIDENCE_ITEM = "struct<url:string,title:string,snippet:string,source_type:string>"
PERSON = "struct<full_name:string,role_title:string>"
COMPANY = "struct<name:string,website:string,country_code:string,employee_estimate:bigint>"
CONSTRAINTS = (
    "struct<target_count:bigint,preferred_country:string,preferred_regions:array<string>,"
    "min_company_size:bigint,max_company_size:bigint,prefer_named_person:boolean,"
    "hard_constraints:array<string>,relaxable_constraints:array<string>>"
)
CLOSE_MATCH = "struct<summary:string,missed_filters:array<string>,reasons:array<string>>"
DECISION = (
    "struct<outcome:string,match_type:string,score:int,summary:string,reasons:array<string>,"
    f"type:string,region:string,close_match:{CLOSE_MATCH}>"
)
COMMERCIAL = (
    "struct<source_notes:string,hooks:array<string>,fit_summary:string,connection_note_draft:string,"
    "dm_draft:string,email_subject:string,email_body:string>"
)
PARSED_ITEM = f"struct<rank:int,item:{EVIDENCE_ITEM},person:{PERSON},company:{COMPANY}>"

BRIEFS = "brief_id bigint, user_text string, request_id string, meta string"
EVIDENCE = "query string, rank int, url string, title string, snippet string, source_type string"
PAGES = "url string, text string"
MEMORY = "scope string, kind string, value string, value_norm string, first_seen bigint"
COUNTERS = "scope string, consecutive_hard_miss_runs bigint"
SEARCH_RESPONSES = "query string, body string"
SELECTIONS = "shortlist_id string, option_number int"
DOSSIER_COLUMNS = ["sourcing_status", "query_used", "person", "company", "fit_signals", "evidence", "notes"]
