"""Schemas of the files that the engine reads, as DDL. Readers are permissive: missing fields are null."""

SCRIPT = "array<struct<_id: string, title: string, subtitle: string, content: string>>"
NODE = "struct<timeline_node_id: string, document_id: string, scene_id: string, scene_order: int, scene_title: string, scene_summary: string, importance: string, role_in_context: string, salient_development: string, goal_state: string, resulting_state: string, unresolved_issue: string, beat_index: int, beat_heading: string, related_event_ids: array<string>, related_episode_ids: array<string>, evidence_quotes: array<string>>"
TIMELINES = f"struct<movie_id: string, language: string, roles: array<struct<character_name: string>>, focal_character_timelines: array<struct<character_name: string, aliases: array<string>, timeline_nodes: array<{NODE}>, timeline_summary: string>>>"
ARCS = "struct<movie_id: string, language: string, cross_scene_arcs: array<struct<arc_id: string, character_name: string, title: string, arc_focus: string, linked_timeline_node_ids: array<string>, arc_summary: string, start_state: string, end_state: string, unresolved_issue: string>>>"
MOVIES = "movie_id string, title string, word_count int, num_scenes int, genre_1 string, genre_2 string, genre_3 string"
QUESTIONS = "id int, movie_id string, language string, related_scenes string, question string, answer string, evidence_or_reason string, question_type string"
REFERENCE = "struct<question_id: string, source_memory_ids: array<string>, supporting_facts: array<string>, contradicting_facts: array<string>, cross_turn_constraints: array<string>>"
SINGLE_TURN = f"struct<instances: array<struct<instance_id: string, character: string, input: struct<dialogue_history: array<struct<speaker: string, text: string>>, current_user_turn: string>, reference: {REFERENCE}>>>"
MULTI_TURN = f"struct<episodes: array<struct<episode_id: string, instance_id: string, episode_instance_id: string, character: string, turns: array<struct<turn_index: int, question_id: string, input: struct<dialogue_history_template: array<struct<speaker: string, text: string, fill_with: string, source_turn_index: int>>, current_user_turn: string>, reference: {REFERENCE}>>>>>"
ROLE_ASSETS = "struct<roles: array<struct<character_name: string, persona_card: struct<traits: array<string>, speaking_style: array<string>, constraints: array<string>, dialogue_exemplars: array<string>>, memories: array<struct<memory_id: string, memory_text: string, scene_order: int, scene_id: string, grounded_facts: array<string>, tags: array<string>>>, relations: array<struct<relation_id: string, target_character: string, relation: string, relation_summary: string>>>>>"
ROLES = "array<struct<language: string, movie_id: string, character: string>>"
EXTRACTION = "map<string, struct<document_metadata: struct<scene_id: string>, entities: array<struct<type: string, name: string, description: string>>>>"
