"""Composable DataFrame -> DataFrame operators, one equality key (by default ``scene_id``) in each."""
