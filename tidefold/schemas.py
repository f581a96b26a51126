"""Schemas of all tables, as DDL."""

HLC = "struct<wallTime:bigint,counter:bigint,deviceId:string>"
OPS = f"v int, id string, hlcTimestamp {HLC}, fileId string, type string, path string, contentHash string, parents array<string>"
OP_RECORDS = "seq bigint, deviceId string, clientOpId string, ts bigint, ciphertext string, blobRefs array<string>"
ENTRIES = f"id string, path string, contentHash string, hlcTimestamp {HLC}, deleted boolean, lastSyncedPath string, headVersionId string, conflictParents array<string>, mtime bigint, size bigint"
VERSIONS = "versionId string, parents array<string>, contentHash string, fileId string"
CONTENTS = "hash string, bytes binary"
LISTING = "path string, mtime bigint, size bigint"
PACK_INDEX = "hash string, packId string, offset bigint, len bigint"
PACKS = "packId string, mtime bigint"
WATCH_EVENTS = "seq bigint, kind string, path string, oldPath string, wall bigint, bytes binary"
CHUNK = "struct<startLine:int,endLine:int,ancestor:array<string>,local:array<string>,remote:array<string>>"
MERGED = f"struct<merged:array<string>,conflicts:array<{CHUNK}>,hasConflicts:boolean,tooLarge:boolean>"
SEGMENTS = "array<struct<kind:string,lines:array<string>,ours:array<string>,base:array<string>,theirs:array<string>>>"
PICKS = "map<int,struct<kind:string,text:array<string>>>"
ACTION = f"id string, rule string, action string, path string, contentHash string, headVersionId string, parents array<string>, hlc {HLC}, merge {MERGED}"

OP_TYPES = ("create", "update", "delete", "move")
EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
