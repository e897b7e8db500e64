"""Column lists of the landing tables the ready-made checks read. Every table also has
`sql_instance STRING, collected_at TIMESTAMP`."""

from __future__ import annotations

from pyspark.sql import types as T

COMMON = "sql_instance STRING, collected_at TIMESTAMP"

LANDING = {
    # servers and settings
    "dim_instance": "edition STRING, product_version STRING, product_level STRING, cpu_count INT, numa_node_count INT, max_workers BIGINT, "
                    "softnuma_configuration INT, virtual_machine_type INT, physical_memory_mb BIGINT, process_memory_low INT",
    "dim_setting": "name STRING, value BIGINT, value_in_use BIGINT",
    "dim_database_setting": "database_name STRING, name STRING, value BIGINT",
    "fact_scheduler": "node_id INT, scheduler_id INT, status STRING, runnable_tasks BIGINT, current_workers BIGINT, active_workers BIGINT",
    "fact_memory_node": "node_id INT, pages_kb BIGINT",
    "fact_memory_clerk": "clerk_type STRING, clerk_name STRING, pages_kb BIGINT",
    "fact_memory_grant": "session_id INT, grant_time TIMESTAMP_NTZ, granted_kb BIGINT, used_kb BIGINT",
    # databases and files
    "dim_database": "database_id INT, database_name STRING, state_desc STRING, recovery_model STRING, compatibility_level INT, collation_name STRING, "
                    "owner_name STRING, owner_sid STRING, log_reuse_wait STRING, is_trustworthy_on BOOLEAN, is_read_only BOOLEAN",
    "dim_file": "database_id INT, file_id INT, name STRING, physical_name STRING, type INT, size BIGINT, max_size BIGINT, growth BIGINT, "
                "is_percent_growth BOOLEAN",
    "fact_file_io": "database_id INT, file_id INT, file_class STRING, num_of_reads BIGINT, num_of_writes BIGINT, io_stall_read_ms BIGINT, "
                    "io_stall_write_ms BIGINT",
    "fact_growth_event": "database_name STRING, file_name STRING, event_class INT, start_time TIMESTAMP_NTZ, integer_data BIGINT",
    "fact_data_space": "database_name STRING, size BIGINT, free BIGINT",
    "fact_log_space": "database_name STRING, size BIGINT, used BIGINT",
    "fact_log_segment": "database_name STRING, vlf_active BOOLEAN, vlf_size_mb DECIMAL(18,4)",
    "fact_table_size": "database_name STRING, object_id INT, table_name STRING, index_id INT, rows BIGINT, total_pages BIGINT, data_pages BIGINT",
    "fact_volume": "host STRING, volume STRING, size_bytes BIGINT, free_bytes BIGINT",
    # sessions, waits, cache
    "fact_session": "session_id INT, blocking_session_id INT, wait_type STRING, wait_ms BIGINT, login_name STRING, transaction_begin_time TIMESTAMP_NTZ, "
                    "log_bytes_used BIGINT, user_alloc BIGINT, user_dealloc BIGINT, internal_alloc BIGINT, internal_dealloc BIGINT, batch_text STRING, "
                    "statement_start INT, statement_end INT, cpu_ms BIGINT",
    "fact_waiting_task": "session_id INT, wait_type STRING, resource STRING, wait_ms BIGINT",
    "fact_wait": "wait_type STRING, tasks BIGINT, wait_ms BIGINT, signal_ms BIGINT, max_wait_ms BIGINT, started_at TIMESTAMP_NTZ",
    "fact_counter": "object_name STRING, counter_name STRING, instance_name STRING, value BIGINT",
    "fact_lock": "resource_type STRING, request_mode STRING, request_status STRING, database_name STRING",
    "fact_cached_plan": "plan_type STRING, use_count BIGINT, size_bytes BIGINT",
    "fact_query_stats": "last_execution_time TIMESTAMP_NTZ, worker_time BIGINT, execution_count BIGINT, spills BIGINT, query_hash STRING",
    "fact_event_document": "document STRING",
    # query history
    "fact_query_runtime": "database_name STRING, query_id BIGINT, plan_id BIGINT, last_execution_time TIMESTAMP_NTZ, count_executions BIGINT, "
                          "avg_duration DOUBLE, avg_tempdb_pages DOUBLE, max_tempdb_pages BIGINT",
    "fact_query_wait": "database_name STRING, plan_id BIGINT, query_id BIGINT, wait_category STRING, total_wait_ms BIGINT",
    "fact_query_plan": "database_name STRING, query_id BIGINT, plan_id BIGINT, query_plan STRING, is_forced_plan BOOLEAN, force_failure_count INT",
    # indexes and statistics
    "fact_index_stats": "database_name STRING, object_id INT, index_id INT, frag_pct DOUBLE, page_count BIGINT, fill_factor INT",
    "fact_index_column": "database_name STRING, object_id INT, index_id INT, index_name STRING, key_ordinal INT, column_name STRING, "
                         "is_descending_key BOOLEAN, is_included_column BOOLEAN, filter_definition STRING, type_desc STRING, is_unique BOOLEAN, is_primary_key BOOLEAN",
    "fact_index_usage": "database_name STRING, object_id INT, index_id INT, reads BIGINT, writes BIGINT",
    "fact_index_place": "database_name STRING, object_id INT, index_id INT, data_space_id INT",
    "fact_missing_index": "database_name STRING, object_id INT, table_name STRING, equality_columns STRING, inequality_columns STRING, "
                          "included_columns STRING, user_seeks BIGINT, avg_total_user_cost DOUBLE, avg_user_impact DOUBLE",
    "fact_row_group": "database_name STRING, object_id INT, state STRING, total_rows BIGINT, deleted_rows BIGINT",
    "fact_foreign_key": "database_name STRING, object_id INT, key_name STRING, leading_column STRING",
    "fact_stats": "database_name STRING, object_id INT, stats_id INT, last_updated TIMESTAMP_NTZ, rows BIGINT, rows_sampled BIGINT, modifications BIGINT",
    "fact_stats_column": "database_name STRING, object_id INT, stats_id INT, ordinal INT, column_name STRING, filter_definition STRING",
    # backups and integrity
    "fact_backup": "backup_set_id BIGINT, database_name STRING, type STRING, start_date TIMESTAMP_NTZ, finish_date TIMESTAMP_NTZ, "
                   "backup_size DECIMAL(20,0), first_lsn DECIMAL(25,0), last_lsn DECIMAL(25,0), differential_base_lsn DECIMAL(25,0), "
                   "is_copy_only BOOLEAN, recovery_model STRING, device_name STRING",
    "fact_log_line": "log_date TIMESTAMP_NTZ, process_info STRING, text STRING, line_id BIGINT",
    "fact_suspect_page": "database_name STRING, file_id INT, page_id BIGINT, event_type INT, error_count INT, last_update_date TIMESTAMP_NTZ",
    "fact_page_repair": "database_name STRING, file_id INT, page_id BIGINT, page_status INT, modification_time TIMESTAMP_NTZ",
    "fact_host_event": "host STRING, provider STRING, level INT, time_created TIMESTAMP_NTZ, message STRING",
    # security
    "dim_principal": "principal_id BIGINT, name STRING, sid STRING, type STRING, is_disabled INT, password_hash STRING, password_last_set TIMESTAMP_NTZ, "
                     "is_policy_checked INT, is_expiration_checked INT",
    "fact_role_member": "role_principal_id BIGINT, member_principal_id BIGINT",
    "fact_permission": "permission_name STRING, grantee_principal_id BIGINT",
    "fact_database_user": "database_name STRING, user_name STRING, sid STRING, role_name STRING",
    "dim_certificate": "name STRING, source STRING, expiry_date TIMESTAMP_NTZ",
    "fact_encryption": "database_name STRING, encryption_state INT, done BIGINT, total BIGINT, expiry_date TIMESTAMP_NTZ",
    "fact_connection": "net_transport STRING, encrypt_option STRING",
    # jobs
    "dim_job": "job_id STRING, job_name STRING, enabled INT, owner_name STRING, notify_operator_id INT",
    "dim_job_step": "job_id STRING, step_id INT, subsystem STRING, command STRING",
    "dim_schedule": "job_id STRING, schedule_enabled INT, next_run TIMESTAMP_NTZ",
    "fact_job_run": "instance_id BIGINT, job_id STRING, step_id INT, run_date INT, run_time INT, run_duration INT, run_status INT, message STRING",
    "fact_alert": "alert_id INT, alert_name STRING, enabled INT, severity INT, message_id INT, notify_mask INT, operator_id INT",
    "dim_operator": "operator_id INT, operator_name STRING, enabled INT",
    "fact_mail": "item_state STRING, item_date TIMESTAMP_NTZ",
    # replicas
    "fact_replica": "group_name STRING, replica STRING, availability_mode STRING, failover_mode STRING, role STRING, operational_state STRING, "
                    "connected_state STRING, sync_health STRING, last_error_time TIMESTAMP_NTZ, backup_preference INT",
    "fact_replica_db": "group_name STRING, replica STRING, database_name STRING, sync_state STRING, send_queue BIGINT, send_rate BIGINT, "
                       "redo_queue BIGINT, redo_rate BIGINT, is_local BOOLEAN",
    "fact_routing": "group_name STRING, replica STRING, priority INT, target STRING",
    "fact_seeding": "database_name STRING, transferred_bytes BIGINT, database_bytes BIGINT",
}


def landing_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(f"{LANDING[table]}, {COMMON}")
