"""Explicit schemas of the tables that cross a file boundary (no inference)."""

from __future__ import annotations

IMAGE = (
    "image_id string, image string, width int, height int, sha256 string, "
    "group_id string, split string, cohort string, source string"
)

OBJECT = (
    "image_id string, instance_id string, source_object_index int, source_name string, "
    "source_type string, x1 double, y1 double, x2 double, y2 double, difficult int, "
    "truncated int, class_id int, class_name string, is_target boolean"
)

VOC_ANNOTATION = (
    "filename string, size struct<width:int,height:int,depth:int>, "
    "object array<struct<name:string,difficult:int,truncated:int,"
    "bndbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>>>"
)

COCO_DOCUMENT = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,"
    "bbox:array<double>,area:double,segmentation:array<array<double>>>>, "
    "categories array<struct<id:int,name:string>>"
)


STAGED_RECORD = (
    "id string, source string, image string, group string, width int, height int, sha256 string, "
    "annotation_status string, objects array<struct<cls:string,xyxy:array<double>>>"
)

CLASS_MAP = "source string, native string, target string, status string"

BOX_SIZES_CSV = "Image string, Width int, Height int"
BOX_RECTS_CSV = "Image string, Left int, Top int, Width int, Height int"

MANIFEST_CSV = (
    "source_id string, group_id string, image_id string, relative_path string, "
    "image_sha256 string, annotation_sha256 string, label_status string, "
    "license_id string, license_review string"
)

ARCHIVED_TEXT = "path string, content string"
