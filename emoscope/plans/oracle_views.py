"""The views of ``plans/views.py`` as DuckDB SQL, for the oracle check.

Written as plain SQL against the pre-registered driver tables, independent of
the Spark code, so that a query and its oracle share no implementation.
"""

from __future__ import annotations

VIEW_SQL = {
    "predictions": """
        WITH e AS (
          SELECT event_id, user_id, event_type AS wav_emo,
                 lag(event_type)  OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pred_emo,
                 lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS txt_emo
          FROM events),
        p AS (
          SELECT event_id, wav_emo, pred_emo, txt_emo,
                 CASE event_id % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'implicit' ELSE 'neutral' END AS txt_cond,
                 concat('m', CAST(user_id % 4 AS VARCHAR)) AS slm,
                 CASE user_id % 3 WHEN 0 THEN 'COSY' WHEN 1 THEN 'F5TTS' ELSE 'STYLE' END AS tts_model,
                 lpad(CAST(user_id AS VARCHAR), 4, '0') AS speaker,
                 lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS nn
          FROM e WHERE pred_emo IS NOT NULL AND txt_emo IS NOT NULL)
        SELECT p.*, CASE WHEN txt_cond = 'neutral'
            THEN concat(nn, '_neutral_', wav_emo, '_', speaker, '_', tts_model, '.wav')
            ELSE concat(nn, '_', txt_emo, '_', txt_cond, '_', wav_emo, '_', speaker, '_', tts_model, '.wav')
          END AS file_name
        FROM p""",
    "binary_predictions": """
        SELECT doc_id, CAST(quality AS VARCHAR) AS y_true, CAST(toxic AS VARCHAR) AS y_pred FROM labels""",
    "utterances": """
        SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.wav' AS audio_path, text,
               n_chars / 15e0 AS duration, source AS speaker, lang AS emotion, lang
        FROM documents""",
    "sentences_wide": """
        SELECT conv_id, turn,
               max(CASE WHEN role = 'user' THEN text END) AS "user",
               max(CASE WHEN role = 'assistant' THEN text END) AS assistant,
               max(CASE WHEN role = 'system' THEN text END) AS system
        FROM conversations GROUP BY conv_id, turn""",
    "frames": """
        SELECT user_id AS utt_id, ts, event_id AS frame_id, value / 500e0 AS rms FROM events""",
    "waves": """
        SELECT vec_id AS utt_id, embedding AS wave, label FROM embeddings""",
    "text_pairs": """
        SELECT d.doc_id AS pair_id, b.text AS ref_text, d.text AS hyp_text, d.lang
        FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""",
    "latency_log": """
        SELECT event_id AS request_id, value / 1000e0 AS latency_s,
               CAST(1 + event_id % 10 AS DOUBLE) AS audio_s, ts, event_type AS kind
        FROM events""",
    "jobs": """
        SELECT t.item_id AS text_id, t.text, e.emotion,
               CASE WHEN e.emotion = 'neutral' THEN 'neutral' ELSE 'emotional' END AS emotion_type,
               CAST(row_number() OVER (ORDER BY t.item_id, e.k) AS BIGINT) AS job_number
        FROM benchmark t,
             (VALUES (1, 'angry'), (2, 'happy'), (3, 'neutral'), (4, 'sad')) e(k, emotion)""",
}


def with_views(body: str, *names: str) -> str:
    """``WITH <view> AS (...) ... <body>`` for the named views (in order)."""
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    return f"WITH {ctes}\n{body}"
