"""retailops: retail data-audit, change-feed and history operators on Spark DataFrames.

Every name below takes and returns DataFrames (or Columns); nothing runs until an
action on the result. Reference dates are arguments, never the wall clock.
"""

from .functions.cols import (after_last, allowed_by, blank_to_null, cents, check_digit, days_between, differs,
                             digits, elapsed_text, in_effect, in_year, int_div, is_present, letter_code, local_time,
                             long_code, maker_id, map_code, minutes_between, newer_than, nth_weekday, nullif_prefix,
                             nvl2, older_than, right, row_max, row_min, safe_next_day, safe_prev_day, shift,
                             still_open, swap_2_3, to_long_code, to_short_code, ts_literal, valid_date, week_start)
from .functions.sqlcode import register_functions, select_columns
from .operators.aggs import (agg_by, count_by, count_by_distinct, count_distinct, count_rows, dup_keys, dup_rows,
                             extent, fact_totals, max_by_key, minus, number_rows, pct, scorecard, sequence_rows,
                             share_of_total, sum_if, top_k, top_rank, union_all, union_distinct, with_count,
                             with_subtotals)
from .operators.joins import (asof_join, case_key_join, checked_broadcast, coalesced_key_join, cross_param,
                              either_key_join, fiscal, flag, has, in_both, join_on_expr, lacks, lookup, lookup_first,
                              lookup_latest, lookup_map, match_null_safe, not_in, one_row, self_join, small_side, star_join, unique_rows)
from .plans.audits import (audit_missing, child_count, code_table, compare, coverage_audit, error_report,
                           reconcile)
from .plans.changes import (append, apply_changes, assign_keys, count_check, delete_details, delete_matching,
                            delete_where, drift, drop_orphans, first_receipts, grain, load_reference, match_lines,
                            merge_upsert, pack_quantities, purge, purge_days, purge_graph, purge_keys, rebuild_lines,
                            repair_status, resync_hierarchy, roll_up_lines, split_deferred, sync_set, update_from,
                            update_where)
from .plans.digests import by_digest, differing_buckets, digest_tree, only_differing
from .plans.history import (advance_week, calendar, calendar_from_range, from_long, history_day, load_history, month_calendar,
                            load_slots, order_weeks, out_of_range, roll_history, roll_slots, rollup_levels, rollup_slots,
                            sum_arrays, to_long, unknown_periods,
                            weeks_ago, widen_history)
from .plans.historylog import HistoryLog
from .plans.levels import LevelTables
from .plans.nested import explode_nested, set_cycles
from .plans.reports import (classify_hosts, cost_list, explode_sets, feed, feed_rejects, fix_batch, in_stock, item_store_detail,
                            missing_changes, name_of, price_list, price_timeline, release_feed, release_report,
                            sectioned_report,
                            shelf_totals, version_in_force)
from .session import (cluster_conf, cut_lineage, drop_scratch, ensure_checkpoint_dir, get_spark, scratch_path,
                      scratch_scope, store)
from .sources.tables import (archive, backup_generations, bucket_table, fits_fixed, format_fixed, keys_in, parse_fixed,
                             read_remote, read_table, refresh, register_environment, replace_table, rows, rtrim_strings, sample_rows, snapshot, stage,
                             write_csv, write_text)
from .sources.filetables import CommitConflict, FileTables
from .sources.fixedwidth import register_fixed_width
from .plans.keyblocks import KeyBlocks
from .streaming.ingest import ingest_changes, read_rejects, read_state, write_change_files
from .streaming.timers import ingest_timed, read_waiting, settled_changes

__all__ = [n for n in dir() if not n.startswith("_")]
