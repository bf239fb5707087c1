"""The engine's entry points, one for each command that a user knows: each returns DataFrames or small dicts."""

from __future__ import annotations

from functools import partial

from .operators.changes import build_registry, change_plan, library_status, lineage, select_libraries, workspace_scan
from .operators.chunking import chunk_documents, chunk_markdown, chunk_pages, pack_lines
from .operators.concepts import concept_graph, concept_index
from .operators.library import build, neighbourhood
from .operators.reports import library_report, metrics, missing_locator_detail, quality_issues
from .operators.search import Filters, diagnostics, facets, locate, multi_library, open_chunk, report_context, search, search_rows
from .operators.workspace import add_to_catalog, build_library, doctor, init_workspace, kb_review, read_catalog, register_library, register_output, run_tool, save_state, update_library, workspace_status
from .sinks.exports import concept_notes, export_vault, vault_notes, write_interop, write_packs, write_portal, write_vault
from .sources.files import convert, read_packs, scan

#: Commands and the functions that stand for them.
COMMANDS = {
    "doctor": doctor, "workspace-init": init_workspace, "workspace-register-library": register_library, "workspace-register-output": register_output,
    "workspace-status": workspace_status, "tool-benchmark": run_tool, "build-library": build_library, "library-status": save_state,
    "source-registry": build_registry, "scan-changes": change_plan, "update-library": update_library, "library-catalog": add_to_catalog,
    "kb-list": read_catalog, "kb-context": multi_library, "search-library": search, "locate-document": locate, "open-chunk": open_chunk,
    "build-report-context": report_context, "library-report": library_report, "export-vault": export_vault, "export-interop": write_interop,
    "convert": convert, "scan": scan, "read-packs": read_packs, "convert-file": convert, "workspace-scan": workspace_scan, "kb-review": kb_review,
    "doctor-layout": partial(doctor, "layout"), "warmup-layout": partial(doctor, "layout"), "doctor-ai": partial(doctor, "enrichment"), "write-packs": write_packs,
    "export-concepts": concept_notes, "write-portal": write_portal, "chunk-documents": chunk_documents,
}

__all__ = [
    "COMMANDS", "Filters", "build", "chunk_markdown", "chunk_pages", "concept_graph", "concept_index", "diagnostics", "facets", "library_status", "lineage", "metrics",
    "missing_locator_detail", "neighbourhood", "pack_lines", "quality_issues", "search_rows", "select_libraries", "vault_notes", "write_vault",
]
