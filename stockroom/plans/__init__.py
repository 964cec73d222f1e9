"""Commands: whole requests over file trees and published snapshots."""
