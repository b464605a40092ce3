"""Column contracts of the logs, the graphs and the panel."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

# Incoming field names and the canonical names they become.
TECH_FIELDS = {
    "project": "project_name",
    "start_date": "project_start_date",
    "end_date": "project_end_date",
    "commit_sha": "commit_id",
    "email": "sender_email",
    "name": "sender_name",
    "date": "date",
    "timestamp": "timestamp",
    "filename": "file_name",
    "change_type": "change_type",
    "lines_added": "added",
    "lines_deleted": "deleted",
    "commit_message": "commit_msg",
}
SOCIAL_FIELDS = {
    "repo_name": "project_name",
    "type": "type",
    "issue_url": "subject",
    "id": "comment_id",
    "title": "title",
    "user_login": "user_name",
    "user_id": "user_id",
    "user_name": "sender_name",
    "user_email": "sender_email",
    "created_at": "date",
    "body": "body",
}
REQUIRED = {
    "tech": ["project_name", "date", "sender_name", "file_name"],
    "social": ["project_name", "date", "sender_name", "subject"],
}
OPTIONAL = {
    "tech": {"month": 0, "is_bot": 0, "is_coding": 0, "author": ""},
    "social": {"month": 0, "is_bot": 0, "in_reply_to": "", "message_id": "", "author": ""},
}

# The features of a project-month, in panel order.
FEATURES = [
    "s_num_nodes",
    "s_weighted_mean_degree",
    "s_num_component",
    "s_avg_clustering_coef",
    "s_largest_component",
    "s_graph_density",
    "t_num_dev_nodes",
    "t_num_file_nodes",
    "t_num_dev_per_file",
    "t_num_file_per_dev",
    "t_graph_density",
    "st_num_dev",
    "t_net_overlap",
    "s_net_overlap",
]
PANEL_COLUMNS = FEATURES[:11] + ["proj_name", "month"] + FEATURES[11:]
COUNT_FEATURES = {
    "s_num_nodes", "s_num_component", "s_largest_component",
    "t_num_dev_nodes", "t_num_file_nodes", "st_num_dev",
}

TRIAL_COLUMNS = [
    "date", "transfer_strategy", "model_arch", "month", "label", "metric", "perf", "support",
]


@dataclass(frozen=True)
class Logs:
    """The technical and the social log of the same projects."""

    tech: DataFrame
    social: DataFrame

    def with_tech(self, tech: DataFrame) -> "Logs":
        return replace(self, tech=tech)

    def with_social(self, social: DataFrame) -> "Logs":
        return replace(self, social=social)
