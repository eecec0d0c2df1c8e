"""Declared schemas of the learning tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, str] = {
    "users": "id long, full_name string, timezone string, status string",
    "subjects": "id long, owner_id long, name string, is_archived boolean, updated_at timestamp",
    "subject_members": "subject_id long, user_id long, member_role string",
    "documents": "id long, owner_id long, subject_id long, original_name string, status string,"
                 " checksum_sha256 string, created_at timestamp",
    "document_sections": "id long, document_id long, title string, section_level short, section_order int",
    "document_chunks": "id long, document_id long, section_id long, chunk_index int, chunk_set_id string,"
                       " chunking_algorithm string, is_active boolean, superseded_at timestamp, content string,"
                       " token_count int, char_count int, content_hash string, metadata string",
    "chunk_embeddings": "chunk_id long, embedding_model string, embedding_dimension int, embedding array<float>",
    "quizzes": "id long, owner_id long, subject_id long, source_quiz_id long, title string, status string,"
               " visibility string, question_count int",
    "questions": "id long, quiz_id long, source_chunk_id long, question_order int, question_text string,"
                 " difficulty string, explanation string, points decimal(8,2)",
    "question_options": "id long, question_id long, option_key string, option_text string, is_correct boolean,"
                        " position short",
    "quiz_attempts": "id long, quiz_id long, user_id long, status string, started_at timestamp,"
                     " submitted_at timestamp, score decimal(10,2), max_score decimal(10,2), correct_count int,"
                     " wrong_count int, unanswered_count int, percentage decimal(6,2)",
    "user_answers": "attempt_id long, question_id long, selected_option_id long, is_correct boolean,"
                    " points_awarded decimal(8,2)",
    "topic_mastery": "user_id long, subject_id long, section_id long, attempts int, correct_answers int,"
                     " wrong_answers int, mastery_score decimal(6,2), last_practiced_at timestamp",
    "user_subject_progress": "user_id long, subject_id long, quizzes_completed int,"
                             " average_score decimal(6,2), last_activity_at timestamp",
    "daily_learning_stats": "user_id long, activity_date date, quiz_attempts int, questions_answered int,"
                            " correct_answers int, flashcards_reviewed int, xp_earned int",
    "flashcard_decks": "id long, owner_id long, subject_id long, source_deck_id long, title string,"
                       " status string, visibility string, created_at timestamp",
    "flashcards": "id long, deck_id long, source_chunk_id long, front_text string, back_text string,"
                  " card_order int",
    "flashcard_reviews": "id long, user_id long, flashcard_id long, rating short, previous_interval int,"
                         " next_interval int, previous_ease decimal(5,2), next_ease decimal(5,2),"
                         " reviewed_at timestamp",
    "flashcard_progress": "user_id long, flashcard_id long, repetitions int, interval_days int,"
                          " ease_factor decimal(5,2), lapse_count int, last_rating short, next_review_at timestamp",
    "study_plans": "id long, user_id long, subject_id long, start_date date, exam_date date, daily_minutes int",
    "study_tasks": "plan_id long, document_id long, section_id long, task_date date, task_type string,"
                   " title string, estimated_minutes int, sort_order int, status string",
    "xp_transactions": "user_id long, amount int, source_type string, source_id long, created_at timestamp",
    "user_gamification": "user_id long, xp_total long, level_no int, current_streak int, longest_streak int,"
                         " last_study_date date",
    "badges": "id long, code string, criteria string, xp_reward int, is_active boolean",
    "user_badges": "user_id long, badge_id long, earned_at timestamp",
    "community_posts": "id long, owner_id long, quiz_id long, flashcard_deck_id long, title string,"
                       " status string, published_at timestamp",
    "community_reactions": "post_id long, user_id long",
    "community_saves": "post_id long, user_id long",
    "messages": "id long, conversation_id long, parent_message_id long, role string, content string,"
                " created_at timestamp",
    "message_citations": "message_id long, chunk_id long, rank_order int, similarity_score decimal(8,6),"
                         " excerpt string",
    "notifications": "id long, user_id long, notification_type string, title string, is_read boolean,"
                     " created_at timestamp",
}


def load(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """S3: scan one learning table with its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder.rstrip('/')}/{name}")
