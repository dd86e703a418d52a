"""Documents to Markdown on Spark, and operators for training data."""

from paperloom.api import (
    VERSION,
    CellContext,
    ConversionError,
    DocumentMetadata,
    ExtractedImage,
    FileType,
    IRBlock,
    IRCell,
    IRTable,
    OutlineItem,
    ParseFailure,
    ParseOptions,
    ParseResult,
    ParseSuccess,
    ParseWarning,
    detect_format,
    detect_ole2_format,
    detect_zip_format,
    parse,
)

__all__ = [
    "VERSION", "CellContext", "ConversionError", "DocumentMetadata", "ExtractedImage", "FileType", "IRBlock", "IRCell", "IRTable", "OutlineItem",
    "ParseFailure", "ParseOptions", "ParseResult", "ParseSuccess", "ParseWarning", "detect_format", "detect_ole2_format", "detect_zip_format", "parse",
]
