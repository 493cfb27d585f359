"""DDL of the entities: raw clusters, question-answer-profile records, annotations, plans and training rows."""

from __future__ import annotations

TAG = "struct<tag_name:string>"
ANSWER = "struct<answer:struct<is_accepted:boolean,body:string>>"
AUTHOR = f"struct<about_me:string,top_tags:array<{TAG}>>"
RAW_CLUSTER = (
    f"canonical struct<question:struct<question_id:string,title:string,body:string>,question_author:{AUTHOR},accepted_answer:{ANSWER}>, "
    f"duplicates array<struct<question_author:{AUTHOR},answers:array<{ANSWER}>>>"
)
PROFILE = "struct<self_description:string,skills:array<string>>"
QAP = f"question_id string, canonical_query string, profiles_answers array<struct<profile:{PROFILE},answer:string>>"
PAIR = f"question_id string, profile {PROFILE}, answer string"
ANNOTATED = f"{PAIR}, is_meaningful boolean, meaningful_confidence string"

LEARNER = "struct<about_me:string,top_tags:array<string>,self_description:string,skills:array<string>>"
AGENT = "struct<agent_role:string,goal:string,backstory:string,description:string,tools:array<string>>"
STEP = "struct<id:string,agent:string,objective:string,instruction:string,tool:string,requires_human_input:boolean,expected_output:string,depends_on:array<string>>"
SUBTASK = f"struct<id:string,name:string,subtask_objective:string,steps:array<{STEP}>>"
#: Elements of execution_order are step ids or loop objects; objects arrive as their JSON text.
OUTPUT = f"struct<agents:array<{AGENT}>,subtasks:array<{SUBTASK}>,execution_order:array<string>>"
INPUT = f"struct<query:string,learner:{LEARNER}>"
PLAN_RECORD = f"question_id string, profile_index int, plan struct<input:{INPUT},output:{OUTPUT}>"
LOOP = "loop struct<step:string,steps:array<string>,condition:string,max_iterations:string>"

MESSAGES = "array<struct<role:string,content:string>>"

#: The closed pool of tools.
TOOLS = (
    "CodeInterpreterTool",
    "CodeDocsSearchTool",
    "FirecrawlSearchTool",
    "FileWriterTool",
    "FileReadTool",
    "DirectoryReadTool",
    "RagTool",
    "ArxivPaperTool",
)
