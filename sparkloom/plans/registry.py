"""All registered queries but those of the optional subpackage."""

from __future__ import annotations

from sparkloom.plans import file_queries, graph_queries, language_queries, link_queries, machine_queries, program_queries, project_queries, record_queries, summary_queries

MODULES = (program_queries, record_queries, language_queries, project_queries, summary_queries, machine_queries, link_queries, graph_queries, file_queries)
#: Queries over programs and rows that are written into them: tests of operators by hand-made cases, not registered.
BY_HAND = frozenset("""
ra03_execution_stats ra05_language_shapes ra10_required_opcodes rb01_builtins rf01_factorial_in_every_language
rg09_function_graphs rg16_cycle_witnesses rg22_program_edges rg22_program_nodes ri06_stored_parameters
ri07_returns_and_accesses ri08_loaded_variables ri10_return_flows ri11_field_flows ri12_pointer_flows ri13_function_summaries
ri14_call_contexts ri15_substituted_flows ri17_whole_program ri21_taint_witnesses ri22_merged_flows ri24_typed_report
ri29_opcode_catalogue rl02_namespaced_symbols rl03_module_bases rl04_expanded_imports rl06_resolved_imports rl07_linked_modules
rl09_import_resolution rl10_project_roots rm03_golden_answers rm04_execution_trace rm04_traced_answers rm07_linked_run
rm17_path_conditions rp06_label_kinds rp13_symbolic_audit rs03_lowered_opcodes rs05_language_imports rs14_file_status
rt05_type_aliases rt06_signatures rt07_subtypes rt08_structural_types rt09_least_upper_bounds rt11_extended_lattice
rv01_opcodes
""".split())
_EVERY = {k: v for m in MODULES for k, v in m.QUERIES.items()}
_SQL = {k: v for m in MODULES for k, v in m.ORACLES.items()}
QUERIES = {k: v for k, v in _EVERY.items() if k not in BY_HAND}
ORACLES = {k: v for k, v in _SQL.items() if k not in BY_HAND}
HAND_QUERIES = {k: v for k, v in _EVERY.items() if k in BY_HAND}
HAND_ORACLES = {k: v for k, v in _SQL.items() if k in BY_HAND}
