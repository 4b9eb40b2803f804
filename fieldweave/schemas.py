"""Schemas of the form-filling tables, as DDL."""

FIELDS = "array<struct<pos:int,name:string,type:string>>"
TEMPLATE = f"id bigint, name string, fields {FIELDS}, pdf_path string, created_at timestamp"
SUBMISSION = "id bigint, template_id bigint, input_text string, output_pdf_path string, created_at timestamp"
WIDGET = "pdf_path string, page int, annot_ix int, subtype string, t string, tu string, ft string, rect array<double>"
ANSWER = "submission_id bigint, pos int, field string, is_plural boolean, values array<string>"
