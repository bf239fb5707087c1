"""Fixed values of the document rules: what is looked for, in which order, and what it is called.

All of them are values that results depend on; the rules that apply them are in rules.py, text.py, chunking.py and library.py.
"""

from __future__ import annotations

#: Kinds of PDF documents by words of the file's name, of its folders, of its content.
NAME_KINDS = [
    ("manual_pdf", ("operating manual", "operation manual")),
    ("functional_description_pdf", ("functional description",)),
    ("fault_catalog_pdf", ("faults and measures", "fault catalog")),
    ("technical_drawing_pdf", ("wiring diagram", "piping and instrumentation", "p&id", "p and id")),
    ("certificate_pdf", ("egcon", "atex", "certificate", "declaration of conformity", "conformity")),
    ("manual_pdf", ("manual", "montage", "installation", "anleitung")),
    ("project_book_pdf", ("project book",)),
    ("report_pdf", ("report", "protokoll", "protocol", "quote", "price")),
    ("datasheet_pdf", ("datasheet", "data sheet", "datenblatt")),
    ("datasheet_pdf", (" data",)),
]
FOLDER_KINDS = [("technical_drawing_pdf", ("piping and instrumentation diagram", "wiring diagram"))]
CONTENT_KINDS = [
    ("manual_pdf", ("operating manual", "operation manual")),
    ("functional_description_pdf", ("functional description",)),
    ("fault_catalog_pdf", ("faults and measures", "fault messages", "measures catalog", "fault catalog")),
    ("technical_drawing_pdf", ("wiring diagram", "schematic", "p&id", "p and id", "piping and instrumentation diagram")),
    ("datasheet_pdf", ("technical data", "datasheet", "data sheet")),
]
COMPONENT_NAME = r"(^|\s)(\d{6,}|fbs\d|phoenix|block|eaton|pfannenberg|lapp|helukabel|insys|abb|st)(\s|$)"
MANUAL_KINDS = ("manual_pdf", "functional_description_pdf", "fault_catalog_pdf")

#: Kinds of office documents: suffix, words, kind; and the weights that speak for a translation table.
OFFICE_KINDS = [
    ("xlsx", ("mpdp", "scaleup phase"), "mpdp_table_xlsx"),
    ("pptx", ("daily rescue eye serum", "m4e"), "process_development_presentation"),
    ("docx", ("release rationale", "pppbc release"), "release_rationale_docx"),
]
TRANSLATION_NAMES, TRANSLATION_NAME_WEIGHT = ("translation_chinese", "translation chinese"), 2
TRANSLATION_HEADERS, TRANSLATION_HEADERS_WEIGHT = ("category", "viewpath", "internal id", "en-gb", "zh-cn"), 3
TRANSLATION_MARK, TRANSLATION_MARKS, TRANSLATION_MARK_WEIGHT = "<hmi screen>", 3, 2
TRANSLATION_PARTS, TRANSLATION_PART_WEIGHT = ("plc+hmi", "bilder", "textfeld"), 1
TRANSLATION_LEAST = 3

#: Tags by words of the path, by kind, by quality.
PATH_TAGS = [
    ("symex", "symex"), ("cml125", "cml125"), ("cml 125", "cml125"), ("wiring diagram", "wiring-diagram"), ("schematic", "schematic"),
    ("terminal diagram", "terminal-diagram"), ("cable overview", "cable-overview"), ("electrical and software design", "electrical-design"),
    ("electrical/software design", "electrical-design"), ("functional description", "functional-description"),
    ("operating manual", "operating-manual"), ("operation manual", "operating-manual"), ("fault catalog", "fault-catalog"),
    ("fault messages", "fault-messages"), ("faults and measures", "fault-catalog"), ("safety", "safety"), ("operation", "operation"),
    ("siemens touch panel", "siemens-touch-panel"), ("cip", "cip"), ("temperature control", "temperature-control"),
    ("flowsheet", "flowsheet"), ("p&id", "p-id"), ("p and id", "p-id"),
    ("piping and instrumentation diagram", "piping-instrumentation-diagram"), ("mechanical design", "mechanical-design"),
]
MECHANICAL_TAGS, MECHANICAL_TAG = ("flowsheet", "p-id", "piping-instrumentation-diagram"), "mechanical-design"
QUALITY_TAGS = {"low_structure": "low-structure", "visual_only": "visual-only"}
DRAWING_TAG = {"technical_drawing_pdf": "technical-drawing"}
KIND_TAGS = {
    "manual_pdf": "operating-manual", "functional_description_pdf": "functional-description", "fault_catalog_pdf": "fault-catalog",
    "generic_pdf": "generic-pdf", "mpdp_table_xlsx": "mpdp", "process_development_presentation": "project-presentation",
    "release_rationale_docx": "release-rationale",
}
OFFICE_TAGS = {
    "process_development_presentation": ("project-presentation", "formula-development", "process-development", "scale-up", "m4e", "symex", "viscosity", "w-o-formula"),
    "mpdp_table_xlsx": ("mpdp", "scale-up-plan", "pilot", "practice", "pre-production", "production", "stability"),
    "release_rationale_docx": ("release-rationale", "pppbc", "commercialization", "process-release", "m4e", "viscosity", "w-si", "skincare"),
    "hmi_translation_xlsx": ("hmi", "translation", "plc-hmi", "bilingual-text"),
}

#: What a page is, by its words.
TITLE_PAGE_WORDS = ("functional description", "production mixer system", "manufacturer", "customer", "year built")
TITLE_PAGE_MANUAL, TITLE_PAGE_NUMBERS = "operating manual", ("machine no", "order no", "symex gmbh")
REVISION_WORDS = ("revision history", "revision overview", "revision table")
PAGE_TITLES = [
    ("terminal line-up", "Terminal Line-up Diagram"), ("terminal lineup", "Terminal Line-up Diagram"),
    ("general project information", "General Project Information"), ("cover sheet", "Cover Sheet"),
    ("enclosure legend", "Enclosure Legend"), ("schematic multi-line", "Schematic Multi-line"), ("power supply", "Power Supply"),
    ("valve station", "Valve Station"), ("panel layout", "Panel Layout"), ("parts list", "Parts List"),
    ("cable overview", "Cable Overview"), ("terminal diagram", "Terminal Diagram"), ("cover", "Cover Sheet"),
    ("terminal", "Terminal Diagram"), ("plc", "PLC"), ("wiring", "Wiring Diagram"), ("schematic", "Schematic"), ("cable", "Cable Overview"),
]
NO_PAGE_TITLE = "Untitled Source Page"

#: Entities by group, as patterns (any case); names in one spelling; numbers that are none.
ENTITY_GROUPS = {
    "organization": (r"\bSymex\b",),
    "line": (r"\bCML\s*125\b", r"\bCML125\b"),
    "document_type": (r"\bwiring diagram\b", r"\bhmi translation\b", r"\bhmi text table\b"),
    "manual_topic": (
        r"\bfunctional description\b", r"\boperating manual\b", r"\bfault messages\b", r"\bfaults and measures\b",
        r"\bsiemens touch panel\b", r"\btemperature control\b", r"\bCIP\b",
    ),
    "drawing_number": (r"(?<![A-Za-z0-9])ENG-\d{6,}(?![A-Za-z0-9])",),
    "project_number": (r"(?<![A-Za-z0-9])SY\d{6,}(?![A-Za-z0-9])",),
    "order_number": (r"(?<![A-Za-z0-9])SY\d{6,}(?![A-Za-z0-9])",),
    "commission_number": (r"\bcommission\s+(?:number|no\.?)\s*[:#-]?\s*([A-Z0-9][A-Z0-9_-]{2,})\b", r"\bcommission\s*[:#-]\s*([A-Z0-9][A-Z0-9_-]{2,})\b"),
    "equipment": (r"\bPLC\b", r"\bHMI\b", r"\bterminal\b", r"\bvalve\b", r"\bmotor\b", r"\bpump\b", r"\bcontrol panel\b"),
}
ENTITY_NAMES = [
    "CML125", "Symex", "PLC", "HMI", "hmi translation", "hmi text table", "wiring diagram", "functional description", "operating manual",
    "fault messages", "faults and measures", "Siemens touch panel", "temperature control", "CIP", "terminal", "valve", "motor", "pump", "control panel",
]
NO_COMMISSION = ("make", "control", "panel")
TITLE_FIELDS = ("manufacturer", "equipment_name", "symex_number", "customer", "year_built", "issue", "revision")
KIND_DOCUMENT_TYPES = {
    "manual_pdf": ("operating manual",), "release_rationale_docx": ("release rationale",), "mpdp_table_xlsx": ("MPDP", "scale-up plan"),
    "process_development_presentation": ("project presentation",), "hmi_translation_xlsx": ("hmi translation", "hmi text table"),
}

#: Titles of slides, lines that are none, topics by title and by text, the topics' order.
SLIDE_TITLES = [
    "General info", "Prototype history information collection", "Submission sensory tracking", "Timeline", "Lab Formula Study",
    "Process flowchart", "Batch", "Pilot Summary", "Spec", "M4E Study", "M4E pilot scale up", "Micro issue", "Formula Technical Risk Assessment",
]
SLIDE_NOISE = ("confidential", "bos", "corporate strategy pre-read")
SLIDE_NOISE_PROJECT, SLIDE_NOISE_STARTS = "daily rescue eye serum", ("project number", "project name")
TITLE_TOPICS = [
    ("Recommendation / Next Step", ("recommendation", "next step")),
    ("Specification / CPP-CQA", ("spec", "cpp", "cqa")),
    ("Batch / Pilot History", ("feasibility study for pilot scale-up", "feasibility study for pilot scale up")),
    ("Micro / Risk Assessment", ("micro issue", "risk assessment", "formula technical risk assessment")),
    ("M4E Study", ("m4e study", "m4e pilot")),
    ("Batch / Pilot History", ("batch", "pilot summary")),
    ("Process Flowchart", ("process flowchart", "flowchart")),
    ("Lab Formula & Process Study", ("lab formula", "formula study")),
    ("Timeline / Milestones", ("timeline", "milestone")),
    ("Sensory / PD Feedback", ("sensory", "feedback", "prototype history")),
    ("Formula & Active System", ("formula structure", "active system")),
    ("Project Overview", ("general info",)),
]
TEXT_TOPICS = [
    ("Recommendation / Next Step", ("recommendation", "next step")),
    ("Specification / CPP-CQA", ("spec", "cpp", "cqa")),
    ("Micro / Risk Assessment", ("micro", "risk assessment")),
    ("Symex + M4E Feasibility Challenge", ("symex", "feasibility", "recirculation")),
    ("M4E Study", ("m4e study", "m4e pilot", "venturi", "timer")),
    ("Batch / Pilot History", ("batch", "pilot summary", "vl", "tc")),
    ("Process Flowchart", ("process flowchart", "flowchart")),
    ("Lab Formula & Process Study", ("lab formula", "formula study")),
    ("Timeline / Milestones", ("timeline", "milestone")),
    ("Sensory / PD Feedback", ("sensory", "feedback", "prototype history")),
    ("Formula & Active System", ("formula structure", "active", "w/o", "high internal water")),
    ("Project Overview", ("general info", "project number", "project name")),
]
NO_TOPIC = "Project Overview"
TOPIC_ORDER = [
    "Project Overview", "Formula & Active System", "Sensory / PD Feedback", "Timeline / Milestones", "Lab Formula & Process Study",
    "Process Flowchart", "Batch / Pilot History", "M4E Study", "Symex + M4E Feasibility Challenge", "Micro / Risk Assessment",
    "Specification / CPP-CQA", "Recommendation / Next Step",
]
VISUAL_WORDS = ("microscopy", "process flowchart", "picture", "image", "missing_asset")

#: Results of batches as patterns (any case), in order; what a result is called, by the pattern that it fits.
RESULTS = [
    r"Shake stability fail", r"Stability fail", r"F/TH fail", r"\bFail\b", r"50kg pilot scale up[:：]\s*Success", r"\bSuccess\b", r"approved",
    r"Pass shake\s*&\s*F/TH stability[^|.]*", r"pass Fth\s*\d*cyc\s*&\s*Shaker", r"Shake stability pass[^|.]*", r"Stability ok", r"Stability:\s*pass", r"\bPass\b",
]
RESULT_NAMES = [
    (r"shake stability fail", "Shake stability fail"), (r"f/th fail", "F/TH fail"), (r"stability fail|\bfail\b", "Fail"), (r"success", "Success"),
    (r"stability ok", "Stability ok"), (r"approved", "Approved"),
]
RISK_TITLE = r"formula technical risk assessment|risk assessment"
BATCH_ID = r"\b(?:VL|TC)\d{6}\b"
BATCH_EVIDENCE = r"\b\d+(?:\.\d+)?\s*kg\b|Symex|M4E|Lee Trimix|Oevel|\b\d+\s*L\s*/?\s*min\b"
BATCH_ROUTES = ("Symex", "M4E", "Lee Trimix", "Oevel")

#: Kinds of evidence that a chunk keeps.
EVIDENCE_TYPES = [
    "section", "slide", "table", "table_section", "topic", "batch_study", "drawing_index", "hmi_translation_table", "hmi_translation_group",
    "hmi_translation_row",
]

#: Phases of a sheet; units of a translation table; parts of its paths that say nothing, or end the group.
SHEET_PHASES = ("PFA", "Pilot", "Practice", "Pre-Production", "Production")
UNITS = ("kg", "%", "°C", "h", "s", "min", "L", "l/min", "L/min", "rpm", "bar")
GROUP_STRUCTURE = ("bilder", "bildverwaltung", "vorlagen", "group", "template", "guid")
GROUP_FIELDS = r"textfeld|textfield|symbolisches\s+ea-feld|ea-feld|bildbaustein|template_schaltfl(?:a|ä|盲)che|schaltfl(?:a|ä|盲)che"
GROUP_ENDS = r"group_\d+|guid_\{?[0-9-]+\}?|text(?:\s+aus)?"
FIELD_NAMELESS = r"text(?:\s+aus)?|guid_\{?[0-9-]+\}?"
GROUP_DEFAULT, FIELD_DEFAULT, SHEET_DEFAULT = "HMI Screens", "Text", "User Texts"
ROWS_AS_CHUNKS, GROUP_LINES, SUMMARY_GROUPS = 250, 40, 20

#: Titles of sections as they are written, and text that a wrong encoding has spoilt.
SECTION_TITLES = {
    "Media supply": "Media Supply", "Siemens touch panel": "Siemens Touch Panel", "Electrical Tempering": "Electrical Tempering",
    "Fault messages": "Fault Messages", "Secondary function": "Secondary Function", "System Start": "System Start", "System start": "System Start",
    "Main phases CML 125": "Main Phases CML 125", "Coaxial agitator": "Coaxial Agitator", "Co-Twister Homogenizer": "Co-Twister Homogenizer",
    "Pressure / Vacuum": "Pressure / Vacuum", "CIP-Advanced (Cleaning In Place)": "CIP-Advanced", "CIP-Drain": "CIP-Drain",
}
SPOILT_TEXT = {"Est茅e": "Esteé"}
SPOILT_CELLS = {"掳C": "°C"}
