"""Input schemas. Every reader states its schema; nothing is inferred."""

TRACK = "struct<name:string,title:string,length:string,format:string>"
REVIEW = "struct<reviewidentifier:string,username:string,reviewbody:string,stars:int,reviewdate:string>"
METADATA = (
    "struct<identifier:string,title:string,date:string,year:string,performance_date:string,coverage:string,"
    "venue:string,location:string,spatial:string,creator:string,description:string,setlist:string,notes:string,"
    "lineage:string,track:string,subject:string,source:string,taper:string,transferer:string,runtime:string>"
)
ITEMS = f"metadata {METADATA}, files array<{TRACK}>, reviews array<{REVIEW}>"

COMMENT = ("show_identifier string,comment_id string,reviewer string,comment_text string,rating int,"
           "created string,is_relevant boolean")
TRANSCRIPT = "title string,url string,transcript string,word_count int,timestamp string"
COMBINED = (
    f"comments array<struct<{COMMENT}>>, setlists map<string,string>, shows_processed array<string>, "
    f"deadcast_transcripts array<struct<{TRANSCRIPT}>>"
)
SONG = "struct<name:string,transition:boolean,notations:array<string>,duration:string,track_file:string>"
RICH_SETLIST = (
    f"sets array<struct<name:string,`order`:int,songs:array<{SONG}>>>, songs array<string>, "
    "transitions array<struct<`from`:string,`to`:string>>, guest_artists array<string>, "
    "song_durations map<string,struct<length:string,format:string,title:string,track_file:string>>, "
    "venue string, date string, creator string, raw_description string, rating string"
)
LEGACY_SETLIST = "array<string>"

DURATIONS = ("show_id string, song string, duration_seconds double, duration_display string, track_file string, "
             "source string, venue string")
INTERPRETATION = "struct<source:string,text:string,url:string,date:string>"
LYRICS = (
    "title string,source_urls array<string>,lyricists array<string>,music_by array<string>,lyrics_text string,"
    f"interpretations array<{INTERPRETATION}>,interpretation_hooks array<string>,first_played_hint string,scraped_at string"
)
SONGLIST = "name string, setlist_mentions bigint"

POST = ("id string,title string,selftext string,author string,score int,created_utc double,url string,"
        "permalink string,num_comments int")
POST_LISTING = f"data struct<after string,children array<struct<kind string,data:struct<{POST}>>>>"

INDEX_ROW = (
    "type string,show_identifier string,created string,rating string,reviewer string,song_name string,duration string,"
    "duration_seconds double,track_file string,guest_artist string,transition_from string,transition_to string,"
    "title string,url string,chunk_index int,word_count int,source_urls array<string>,lyricists array<string>,"
    "music_by array<string>,interpretation_source string,interpretation_url string,comment_text string,source string,idx bigint"
)
LISTING_PAGE = "response struct<numFound:bigint,start:bigint,docs:array<struct<identifier:string>>>"
STAGING = (
    "inferences array<struct<song_name:string,canonical_title:string,status:string,tag:string,proposed_tags:string,"
    "primary_vocalist:string,backup_vocalists:array<string>,plausible_singers:array<struct<name:string,tag:string>>,"
    "confidence:string,confidence_score:int,sources:array<string>,year:int>>"
)
DECISIONS = "song_name string, status string, tag string, primary_vocalist string, decided_at string"
