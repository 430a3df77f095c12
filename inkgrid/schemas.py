"""Fixed schemas of the tables that operators take and return."""

from __future__ import annotations

IMAGES = "image_id string, path string, height int, width int, n_channels int, data binary"
PIXELS = "image_id long, y int, x int, v int"
PIXELS_BGR = "image_id long, y int, x int, b int, g int, r int"
RAW_OCR = "document_name string, variant string, page int, rec_texts array<string>, rec_scores array<double>, dt_polys array<array<array<double>>>"
CORNERS = "struct<top_left: array<double>, top_right: array<double>, bottom_right: array<double>, bottom_left: array<double>>"
BLOCKS = f"document_name string, variant string, block_idx int, text string, confidence double, bbox {CORNERS}"
QUALITY = "document_name string, blur_score double, is_blurry boolean, preprocessing_applied boolean"
SEGMENTS = "image_id long, x1 int, y1 int, x2 int, y2 int"
